"""Files as rows of lines, whatever their size: Spark splits a large file by bytes, and lines get their numbers from the counts of the splits before.

A split's lines carry an ascending number from the scan itself; one small row a
split (how many lines, which number is the first) and a running sum over a file's
splits, range by range, turn it into the line number. No line moves for it.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.operators.filters import path_filter
from textquarry.operators.ordinals import carried
from textquarry.plans.spec import QuerySpec
from textquarry.sources.corpus import is_remote, located, root_paths, tops, utf8


@dataclass
class Lines:
    """rows: path, block, i, text, with i ascending in a block, and blocks in a path. blocks: path, block, n (rows of it), first (the first line's i), base (lines before the block), n_lines (of the path; the last one is empty and has no row where that is one more than the rows), bom (its first line has lost a byte order mark)."""

    rows: DataFrame
    blocks: DataFrame

    @classmethod
    def of(cls, rows: DataFrame) -> Lines:
        """Rows whose blocks make up their paths: nothing stands between or behind the lines."""
        return cls(rows, _numbered(rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.lit(0).alias("bytes")), F.lit(0), F.lit(False)))


def _numbered(counts: DataFrame, more: Column, bom: Column) -> DataFrame:
    """more: lines of the path that no row stands for. Both may use _bytes, those of the path's rows. No task needs a row of all blocks of a path."""
    counts = counts.persist()  # a row a block, and read several times
    whole = counts.groupBy("path").agg(F.sum("n").alias("_rows"), F.sum("bytes").alias("_bytes"))
    found = carried(counts, "path", "block", base=("sum", "n", False)).join(whole, "path")
    return found.select("path", "block", "n", "first", F.coalesce("base", F.lit(0)).alias("base"), (F.col("_rows") + more).alias("n_lines"), bom.alias("bom"))


def lines_of_files(files: DataFrame) -> Lines:
    """Lines of rows of the text reader: path, block, size (of the file), value, i.

    Lines end at newlines alone. The reader gives no line behind the last newline,
    and drops a byte order mark; the sum of a file's bytes tells of both.
    """
    counts = files.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max("size").alias("size"))
    short = F.col("_bytes") - F.col("size")
    # 1: no newline at the end; 0: one; -2 and -3: the same without the mark's three bytes.
    blocks = _numbered(counts, F.when(short.isin(0, -3), 1).otherwise(0), short.isin(-2, -3))
    return Lines(files.select("path", "block", "i", utf8(F.col("value")).alias("text")), blocks)


def large_files(spark: SparkSession, spec: QuerySpec, cwd: str | None = None) -> DataFrame:
    """Rows of the text reader of the files that spec's size guard leaves out, and that its extensions and path rules keep; with rel, as it is seen from the working folder.

    Spark lists and splits them, so names with a leading underscore are not among them.
    """
    cwd = os.path.abspath(cwd or os.getcwd())
    roots = root_paths(spec, cwd)
    names = "*.{" + ",".join(spec.extensions) + "}" if len(spec.extensions) > 1 else f"*.{spec.extensions[0]}"
    df = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", names).option("ignoreMissingFiles", True).text(tops(roots, hidden=(".", "_")))
    path = F.col("_metadata.file_path")
    path = path if any(map(is_remote, roots)) else F.regexp_replace(path, "^file:/+", "/")
    # Size and path are known from the listing: what they rule out isn't opened.
    df = df.where(F.col("_metadata.file_size") > spec.max_bytes).select(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")
    return path_filter(located(df, roots, spec, cwd), spec).withColumn("i", F.monotonically_increasing_id())
