"""The corpus pipeline: documents in, tokens out, in stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which are
stored; all but the last return the columns of documents. ``run`` stores each
stage's rows in the shared folder and reads them again, so that no stage is
computed twice and a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from textquarry.llm import minhash, mixing, pii, quality, sentencepiece_codec
from textquarry.llm.common import BROADCAST_ROWS, WORD, materialize, semi_join, table

#: Near-duplicates of the corpus: shingles of five words, in at least 80 of 100 of the union.
SHINGLE, THRESHOLD = 5, 80


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    score = quality.trained(docs, table(spark, sf_dir, "labels"))
    return docs.where(score("text") >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id; of rows that repeat an id and text, the first by their columns."""
    key = ["doc_id", "_pipeline_key"]
    found = materialize(minhash.near_duplicates(docs, SHINGLE, THRESHOLD).select("doc_id", F.col("key").alias("_pipeline_key"), "kept"), "pipeline-near")
    gone = materialize(found.where(~F.col("kept")).select(*key).distinct(), "pipeline-gone")
    keyed = docs.withColumn("_pipeline_key", F.xxhash64("text"))
    out = semi_join(keyed, gone, key, "left_anti")
    repeated = materialize(found.where("doc_id IS NOT NULL").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "pipeline-repeated")
    if repeated.isEmpty():
        return _columns(out, docs)
    row = lambda kept: F.struct(*(F.col(f"`{f.name}`") for f in docs.schema.fields if kept(f)))
    order = row(lambda f: not isinstance(f.dataType, (MapType, VariantType)))
    again = semi_join(out, repeated, key).groupBy(*key).agg(F.min_by(row(lambda f: True), order).alias("_pipeline_row"))
    again = again.select(*(F.col(f"_pipeline_row.`{c}`").alias(c) for c in docs.columns))
    return _columns(semi_join(out, repeated, key, "left_anti"), docs).unionByName(again)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are named by kind, terms that reveal them generalised or removed; n_chars follows the text."""
    out = pii.sanitise(docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("clean"))
    new = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those it doesn't take go."""
    mixed = mixing.mix(docs).where("copies > 0").select(F.col("doc_id").alias("_mix_doc"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), F.col("copies").alias("_mix_copies"))
    mixed = materialize(mixed.dropDuplicates(["_mix_doc", "_mix_source", "_mix_size"]), "pipeline-mix")
    same = docs["doc_id"].eqNullSafe(F.col("_mix_doc")) & docs["source"].eqNullSafe(F.col("_mix_source"))
    if not mixed.groupBy("_mix_doc", "_mix_source").count().where("count > 1").isEmpty():
        # Rows that share id and source, but not the size that their copies go by.
        same &= F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) == F.col("_mix_size")
    small = mixed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = docs.join(F.broadcast(mixed) if small else mixed, same)
    return _columns(out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))), docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: doc_id, n_tokens, ids, audited, differing, round_trip."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("personal data", hide_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenise),
]

#: A trained network and a tokenizer have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage-" + name.replace(" ", "-"))
    return docs
