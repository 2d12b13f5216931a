"""The pipeline's stages, one by one, and whole."""

import hashlib

import corpus_pipeline
from textquarry.llm import minhash, mixing, pii
from textquarry.llm.common import materialize


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, data), "test")
        at[name] = (before, docs)
        if name != "tokens":
            assert docs.columns == columns
    before, after = at["quality"]
    assert 0.6 * before.count() < after.count() < before.count()
    before, after = at["near duplicates"]
    kept = minhash.near_duplicates(before, corpus_pipeline.SHINGLE, corpus_pipeline.THRESHOLD).where("kept")
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in kept.collect()}
    before, after = at["personal data"]
    assert after.count() == before.count()
    assert pii.detect(after).where("exists(found, s -> s.ord < 4)").count() == 0
    assert after.where("n_chars <> length(text)").count() == 0
    before, after = at["mixing"]
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
    assert after.groupBy("doc_id").count().where("count > 3").count() == 0
    before, after = at["tokens"]
    assert after.count() == before.count()
    assert after.where("NOT round_trip OR differing > 0").count() == 0
    whole = lambda df: sorted(hashlib.md5(repr((r["doc_id"], r["ids"])).encode()).hexdigest() for r in df.collect())
    assert whole(corpus_pipeline.run(spark, data)) == whole(after)


def test_repeated_rows_and_clashing_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(30).selectExpr("*", "1 AS score", "'x' AS row", "2 AS copies", "3 AS kept", "4 AS key", "5 AS found", "6 AS _d", "7 AS audited", "map(1, 2) AS ids", "8 AS target")
    docs = docs.unionByName(docs.limit(5))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, data), "test")
        assert docs.columns == columns
    assert corpus_pipeline.tokenise(spark, docs, data).count() == docs.count() > 0


def test_rows_that_share_an_id(spark, data):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "a"), (1, words, "b"), (1, "quite another text of some words", "b"), (2, words + " x", "a"), (None, words, "a"), (3, None, None), (3, "", None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"], r["source"]) for r in left))) == sorted(map(str, [rows[0], rows[2], rows[4], rows[5], rows[6]]))
    mixed = corpus_pipeline.mix_sources(spark, docs, data).collect()
    taken = mixing.mix(docs).agg({"copies": "sum"}).first()[0]
    assert len(mixed) == taken


def test_empty_table(spark, data, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and out.columns[0] == "doc_id"
