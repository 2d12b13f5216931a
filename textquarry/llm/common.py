"""What the training-data operators share: input, tables written on the way, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the word rule: space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

#: Sides with at most this many rows of two numbers are broadcast (16 MB as a hash table, about); larger ones are shuffled.
BROADCAST_ROWS = 250_000

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset, as in tests, a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="textquarry-"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textquarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(StructType(df.schema.fields)).parquet(path)
    out._stored = path
    return out


def release(*stored: DataFrame) -> None:
    """Deletes tables of materialize that nothing will read again."""
    for df in stored:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """True where crc32 of the id's decimal text is divisible by 5: rows that no label is learnt from."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def unit_hash(*parts: Column, seed: int = 0) -> Column:
    """A repeatable number in (0, 1) from the parts."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def semi_join(left: DataFrame, keys: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """left rows whose key is (``left_anti``: is not) in keys, which must be a stored table. keys is broadcast only if it was counted to be small."""
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(keys) if small else keys, key, how)


#: Characters of text that a sample of labelled rows holds at most; a fit on the driver needs some ten times as many bytes.
SAMPLE_CHARS = 24_000_000


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most per_class training rows of each class, in the order of a hash of doc_id, and of chars characters at most.

    Held-out rows never enter. The ids are chosen from the narrow label table
    first, so that only 2 * per_class texts are ever moved. Of rows that share a
    doc_id the smallest text counts; a text that would go beyond chars is left out.
    """
    training = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    order = F.xxhash64(F.lit(17), "doc_id")
    ids = [training.where(F.col("_y") == y).dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    rows = documents.select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").where(F.col("text").isNotNull())
    rows = materialize(rows.groupBy("doc_id", "_y").agg(F.min("text").alias("text")), "labelled")
    chosen, left = [], chars
    for r in rows.select("doc_id", "_y", F.length("text").alias("n"), order.alias("_o")).sort("_o", "doc_id", "_y").collect():
        if r["n"] <= left:
            chosen.append(r["doc_id"])
            left -= r["n"]
    found = rows.where(F.col("doc_id").isin(chosen)).collect() if chosen else []
    release(rows)
    found.sort(key=lambda r: (r["doc_id"], r["_y"]))
    return [r["text"] for r in found], [r["_y"] for r in found]


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts are handed to Python at most so many rows at a time. This changes a setting of the session; spark.sql.execution.arrow.maxBytesPerBatch (64 MB) bounds batches of long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
