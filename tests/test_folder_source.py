"""The folder source: filters that go down to it, and the stream."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

from textquarry.plans.spec import QuerySpec
from textquarry.search import Search
from textquarry.sources.corpus import FolderSource, _FilteringReader, _FolderReader, files_corpus, files_stream, holds
from textquarry.streaming import summary
from textquarry.streaming.search import search_stream

TS = QuerySpec(strings=("TODO",), extensions=("ts",), lines=1)


@pytest.fixture()
def folder(tmp_path):
    for name, text in {"a.ts": "TODO\n1", "_b.ts": "x\nTODO TODO\ny", "sub/c.ts": "none", "sub/deep/d.ts": "TODO " * 50, "other/e.md": "TODO"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


@pytest.fixture()
def files(spark, folder):
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark.read.format("folder").option("pushdown", "true").load(str(folder)).where("path IS NOT NULL")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_on_path_and_length_go_down(spark, folder, files):
    os.mkfifo(folder / "other" / "pipe.ts")  # whoever opens it waits for ever
    (folder / "big.ts").write_text("x" * 10_000)
    os.chmod(folder / "big.ts", 0)
    top = f"{folder}/"
    for condition, names in (
        ((F.col("length") <= 300) & F.endswith("path", F.lit(".ts")) & ~F.contains("path", F.lit("/deep/")), {"a.ts", "_b.ts", "sub/c.ts"}),
        (F.startswith("path", F.lit(top + "sub/")) & (F.col("length") > 10), {"sub/deep/d.ts"}),
        (F.col("path").isin(top + "a.ts", top + "no.ts", top + "sub/c.ts"), {"a.ts", "sub/c.ts"}),
        (F.col("path") == top + "other/e.md", {"other/e.md"}),
        # Not one that goes down: what went down for the query before counts for nothing now.
        ((F.col("length") < 4) | F.endswith("path", F.lit("c.ts")), {"sub/c.ts"}),
    ):
        found = files.where(condition)
        assert {r["path"].removeprefix(top) for r in found.select("path").collect()} == names
    assert files.count() == 6
    plan = formatted(files.where((F.col("length") <= 300) & F.endswith("path", F.lit(".ts"))))
    # Settled in the scan: no filter is left above it.
    assert "Filter (" not in plan
    assert all(x in plan.split("PushedFilters")[1] for x in ("IsNotNull(path)", "LessThanOrEqual(length,300)", "StringEndsWith(path,.ts)"))


def test_only_folders_that_a_filter_reaches_are_walked(folder, monkeypatch):
    seen, listed = [], _FolderReader._listed
    monkeypatch.setattr(_FolderReader, "_listed", lambda self, f, prune: (seen.append(os.path.relpath(f, folder)), listed(self, f, prune))[1])
    opened = []
    monkeypatch.setattr("builtins.open", lambda p, *a, f=open, **k: (opened.append(str(p)), f(p, *a, **k))[1])
    reader = _FilteringReader({"path": str(folder), "folders": "1000"})
    left = reader.pushFilters([StringStartsWith(("path",), f"{folder}/sub/d"), LessThanOrEqual(("length",), 1000), EqualTo(("error",), "x")])
    assert left == [EqualTo(("error",), "x")]
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [f"{folder}/sub/deep/d.ts"]
    assert set(seen) == {".", "sub", "sub/deep"} and opened == [f"{folder}/sub/deep/d.ts"]


def test_filters_mean_what_sql_means():
    p = ("path",)
    assert [holds(f, "b") for f in (EqualTo(p, "b"), Not(EqualTo(p, "b")), In(p, ("a", None)), Not(In(p, ("a", None))), In(p, ("b", None)), StringContains(p, ""), StringEndsWith(p, "ab"), GreaterThan(p, "a"), IsNotNull(p))] == [True, False, None, None, True, True, False, True, True]
    assert [holds(f, None) for f in (EqualTo(p, "b"), Not(EqualTo(p, "b")), In(p, ("a",)), IsNotNull(p), Not(IsNotNull(p)))] == [None, None, None, False, True]


def test_the_guard_of_a_search_goes_down(spark, folder):
    spec = TS.where(max_bytes=100)
    try:
        search = Search(files_corpus(spark, spec, str(folder), pushdown=True), spec)
        assert "LessThanOrEqual(length,100)" in formatted(search.selected)
        assert {r["rel"] for r in search.selected.collect()} == {"a.ts", "_b.ts"}
        # Candidates are not guarded, also after a query that is.
        assert search.candidates.count() == 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def drained(query):
    query.awaitTermination()
    assert query.exception() is None


def test_stream_goes_on_where_it_ended(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("stream"))

    def run():
        time.sleep(0.4)
        stream = search_stream(files_stream(spark, TS, str(folder), settle=0.2), TS)
        drained(stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start())
        return sorted((r["rel"], r["n_matches"]) for r in spark.read.parquet(f"{at}/out").collect())

    os.utime(folder / "a.ts", (1, 1))  # old times don't hide a file
    assert run() == [("_b.ts", 2), ("a.ts", 1), ("sub/deep/d.ts", 50)]
    (folder / "_new.ts").write_text("TODO")
    os.utime(folder / "_new.ts", (1, 1))
    assert run() == [("_b.ts", 2), ("_new.ts", 1), ("a.ts", 1), ("sub/deep/d.ts", 50)]
    assert len(run()) == 4


def test_summary_follows_changes(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("summary"))

    def run():
        time.sleep(0.4)
        changes = summary.summary_changes(files_stream(spark, spec, str(folder), settle=0.2), spec)
        drained(summary.keep_totals(changes, f"{at}/totals", f"{at}/checkpoint", once=True))
        batch = Search(files_corpus(spark, spec, str(folder)), spec)
        assert summary.totals(spark, f"{at}/totals").collect() == batch.totals().collect()
        assert summary.extensions(spark, f"{at}/totals").collect() == batch.extensions().collect()
        return summary.totals(spark, f"{at}/totals").first()["total_matches"]

    spec = TS.where(extensions=("ts", "md"))
    assert run() == 54
    (folder / "a.ts").write_text("TODO TODO\n\n\n\n\nTODO")
    (folder / "other" / "e.md").write_text("nothing now")
    (folder / "f.ts").write_text("TODO")
    assert run() == 56
    assert run() == 56


def test_offsets_and_parts_of_a_stream(folder, monkeypatch):
    from textquarry.sources.corpus import _FolderStream

    stream = _FolderStream({"path": str(folder), "settle": "0"})
    start = stream.initialOffset()
    time.sleep(0.05)
    end = stream.latestOffset()
    monkeypatch.setattr(_FolderStream, "FILES", 2)
    parts = stream.partitions(start, end)
    assert [len(p.files) for p in parts] == [2, 2, 1]
    rows = [r for p in parts for r in stream.read(p)]
    assert {os.path.relpath(r[0], folder) for r in rows} == {"a.ts", "_b.ts", "sub/c.ts", "sub/deep/d.ts", "other/e.md"}
    # Nothing new: the offset stays, and a batch of it is empty.
    assert stream.latestOffset() == end and not [r for p in stream.partitions(end, end) for r in stream.read(p)]
    # A reader that starts anew lists the same files for the same batch; what has changed since is left to a later one.
    time.sleep(0.05)
    (folder / "a.ts").write_text("changed")
    again = _FolderStream({"path": str(folder), "settle": "0"})
    assert {os.path.relpath(r[0], folder) for p in again.partitions(start, end) for r in again.read(p)} == {"_b.ts", "sub/c.ts", "sub/deep/d.ts", "other/e.md"}
    assert not [r for r in stream.read(next(p for p in parts if str(folder / "a.ts") in p.files)) if r[0].endswith("/a.ts")]
    time.sleep(0.05)
    assert [r[2] for p in again.partitions(end, again.latestOffset()) for r in again.read(p)] == [b"changed"]
    # Files that have just changed wait.
    assert _FolderStream({"path": str(folder), "settle": "3600"}).latestOffset() == start


def test_streams_need_a_folder(spark):
    with pytest.raises(ValueError, match="without a scheme"):
        files_stream(spark, TS.where(roots=("hdfs://a/b",)))
