"""A summary that follows a changing folder: a file that comes again replaces what it counted for before.

State is one row of counts a path. A batch's files give differences to it, and these
are added to totals by extension, a table of a few rows that each batch writes anew
beside that of the batch before; a batch that is run again writes the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from textquarry.functions.text import extension, token_estimate
from textquarry.operators import render
from textquarry.operators.filters import content_conditions, path_filter, scan_filter
from textquarry.operators.windows import match_count, with_windows
from textquarry.plans.spec import QuerySpec

COUNTS = ("files", "matches", "windows", "chars")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_counts(corpus: DataFrame, spec: QuerySpec) -> DataFrame:
    """path, ext and what each candidate counts for; zeros for one that the content filters drop, since it may have counted before."""
    kept = F.lit(True)
    for condition in content_conditions(spec):
        kept &= F.coalesce(condition, F.lit(False))
    files = path_filter(scan_filter(corpus, spec), spec)
    size = F.when(render.gives_block(spec), render.block_size(spec))
    matches = windows = F.lit(0)
    if spec.context:
        files = with_windows(files, spec.pattern, spec.context, chars=True, lines=False, matches=False)
        matches, windows = match_count(F.col("windows")), F.size("windows")
    values = {"files": F.lit(1), "matches": matches, "windows": windows, "chars": size}
    return files.select("path", F.lower(extension(F.col("rel"))).alias("ext"), *(F.when(kept, F.coalesce(v, F.lit(0))).otherwise(0).cast("long").alias(c) for c, v in values.items()))


class _Latest(StatefulProcessor):
    """The counts of a path as last seen; out go the differences."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", ", ".join(f"{c} long" for c in COUNTS))

    def handleInputRows(self, key, rows, timerValues):
        before = self.last.get() if self.last.exists() else (0,) * len(COUNTS)
        # The source gives a path once a batch; of several the last counts.
        for now in rows:
            pass
        self.last.update(tuple(now[c] for c in COUNTS))
        yield Row(path=key[0], ext=now["ext"], **{c: now[c] - b for c, b in zip(COUNTS, before, strict=True)})

    def close(self) -> None:
        pass


def summary_changes(corpus: DataFrame, spec: QuerySpec) -> DataFrame:
    """path, ext and the change of each count, of files of a stream. State is kept by RocksDB, which this sets in the session."""
    corpus.sparkSession.conf.set(PROVIDER, ROCKSDB)
    schema = "path string, ext string, " + ", ".join(f"{c} long" for c in COUNTS)
    return file_counts(corpus, spec).groupBy("path").transformWithState(statefulProcessor=_Latest(), outputStructType=schema, outputMode="Append", timeMode="None")


def _by_ext(changes: DataFrame) -> DataFrame:
    return changes.groupBy("ext").agg(*(F.sum(c).alias(c) for c in COUNTS))


def keep_totals(changes: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts to keep totals by extension in folder, which all executors share. once: with what is there now, then it ends."""

    def add(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        parts = _by_ext(batch)
        if n:
            parts = _by_ext(parts.unionByName(spark.read.schema(parts.schema).parquet(f"{folder}/batch={n - 1}")))
        parts.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    writer = changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(availableNow=True) if once else writer).start()


def by_extension(spark: SparkSession, folder: str) -> DataFrame:
    """ext and counts after the last batch."""
    rows = spark.read.parquet(folder)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """The row of ``Search.totals`` after the last batch."""
    whole = by_extension(spark, folder).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"total_{c}") for c in COUNTS))
    return whole.withColumn("total_tokens", token_estimate(F.col("total_chars")))


def extensions(spark: SparkSession, folder: str) -> DataFrame:
    """Those of files that are selected now."""
    return by_extension(spark, folder).where("files > 0 AND ext <> ''").select("ext").orderBy("ext")
