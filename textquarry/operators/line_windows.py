"""Matches and windows of files that are rows of lines (``sources.lines``): the same as of whole texts, for files of any size.

Matching lines meet those of their own block only. What crosses blocks is settled on
one row a block: where its first and last window are, and how many it has.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import pad_start
from textquarry.operators.ordinals import carried
from textquarry.operators.render import BAR, BETWEEN
from textquarry.operators.windows import line_matches
from textquarry.plans.spec import QuerySpec
from textquarry.sources.lines import Lines

BLOCK = ["path", "block"]
#: Blocks whose edges are sent to all tasks, so that lines stay where they are read; of more, lines are dealt by block.
BROADCAST_BLOCKS = 100_000


def _located(found: DataFrame, lines: Lines) -> DataFrame:
    """found with the line number of i, n_lines of the path, and bom on its first line."""
    line = F.col("base") + F.col("i") - F.col("first") + 1
    return found.join(lines.blocks.withColumnRenamed("n", "n_rows"), BLOCK).withColumn("line", line.cast("int")).withColumn("bom", F.col("bom") & (F.col("line") == 1)).drop("i", "first", "base", "n_rows")


def line_positions(lines: Lines, pattern: str) -> DataFrame:
    """path, line, column, match of all matches."""
    found = lines.rows.where(F.col("text").rlike(pattern)).select(*BLOCK, "i", F.explode(line_matches(F.col("text"), F.lit(0), pattern)).alias("m")).select(*BLOCK, "i", "m.column", "m.match")
    return _located(found, lines).select("path", "line", (F.col("column") + F.col("bom").cast("int")).alias("column"), "match")


def line_windows(lines: Lines, pattern: str, n: int) -> DataFrame:
    """path, start_line, end_line, n_matches of the windows of n lines around matches, those that touch or overlap as one."""
    found = _located(lines.rows.where(F.col("text").rlike(pattern)).select(*BLOCK, "i", F.regexp_count("text", F.lit(pattern)).alias("n")), lines)
    in_block = Window.partitionBy(*BLOCK).orderBy("line")
    apart = F.coalesce(F.col("line") - F.lag("line").over(in_block) > 2 * n + 1, F.lit(False)).cast("long")
    found = found.withColumn("apart", apart).withColumn("k", F.sum("apart").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    # Windows of a block, numbered from 0.
    own = found.groupBy(*BLOCK, "k").agg(F.min("line").alias("head"), F.max("line").alias("last"), F.sum("n").cast("long").alias("n_matches"), F.max("n_lines").alias("n_lines"))
    # A block's first window goes on one of the block before if these are near enough; its others are new.
    edges = own.groupBy(*BLOCK).agg(F.min("head").alias("head"), F.max("last").alias("last"), F.max("k").alias("k")).persist()
    edges = carried(edges, "path", "block", before=("max", "last", False))
    new = F.coalesce((F.col("head") - F.col("before") > 2 * n + 1).cast("long"), F.lit(1))
    edges = carried(edges.select(*BLOCK, new.alias("new"), (F.col("k") + new).alias("more")).persist(), "path", "block", earlier=("sum", "more", False))
    edges = edges.select(*BLOCK, (F.coalesce("earlier", F.lit(0)) + F.col("new")).alias("at"))
    numbered = own.join(edges, BLOCK).withColumn("window", F.col("at") + F.col("k"))
    return numbered.groupBy("path", "window").agg(
        F.greatest(F.lit(1), F.min("head") - n).alias("start_line"), F.least(F.max("n_lines"), F.max("last") + n).cast("int").alias("end_line"), F.sum("n_matches").alias("n_matches")).drop("window")


def _edges(lines: Lines, pattern: str) -> DataFrame:
    """Each block's numbers, the last match before it and the first one behind it, as line numbers."""
    found = lines.rows.where(F.col("text").rlike(pattern)).groupBy(*BLOCK).agg(F.min("i").alias("head"), F.max("i").alias("last"))
    line = lambda c: F.col("base") + F.col(c) - F.col("first") + 1
    own = lines.blocks.join(found, BLOCK, "left").withColumn("head", line("head")).withColumn("last", line("last")).persist()
    # Lines ascend with their blocks: the last match before a block is the greatest of those before, the first one behind it the least of those behind.
    own = carried(own, "path", "block", before=("max", "last", False), behind=("min", "head", True))
    # The empty line behind a last newline has no row: it is a line of the path's last block.
    total = F.col("base") + F.col("n")
    end = F.when(F.col("n_lines") == total + 1, F.col("n_lines"))
    return own.select(*BLOCK, F.col("first").alias("_first"), "base", "bom", "before", "behind", end.alias("end"), F.coalesce("last", "before").alias("upto"))


def _near(rows: Iterator[tuple], n: int) -> Iterator[tuple]:
    """Of rows (path, block, line, text, hit, before, behind) in order: path, line, text, and whether a window begins there, and whether it is the path's first; of all lines that are at most n away from a match."""
    now, held = None, deque(maxlen=n)
    last = behind = None

    def shown(path: str, line: int, text: str, following: int | None) -> tuple:
        """following: the next match from this line on; last: the one before it. The line before is shown, too, if either is near it."""
        joined = line > 1 and (last is not None and line - 1 - last <= n or following is not None and following - (line - 1) <= n)
        return path, line, text, not joined, last is None

    def rest() -> Iterator[tuple]:
        return (shown(now[0], line, text, behind) for line, text in held if behind is not None and behind - line <= n)

    for path, block, line, text, hit, before, after in rows:
        if (path, block) != now:
            if now is not None:
                yield from rest()
            now, last, behind = (path, block), before, after
            held.clear()
        if hit:
            # The lines held are the last n before it.
            yield from (shown(path, k, t, line) for k, t in held)
            held.clear()
            yield shown(path, line, text, line)
            last = line
        elif last is not None and line - last <= n:
            yield shown(path, line, text, behind)
        else:
            held.append((line, text))
    if now is not None:
        yield from rest()


def context_lines(lines: Lines, pattern: str, n: int) -> DataFrame:
    """path, line, text, begins (a window) and first (of the path's windows) of the lines of all windows. Lines go through their tasks once, in order; what lies in other blocks is known from these' edges."""
    edges = _edges(lines, pattern).persist()  # a row a block, and read three times
    few = edges.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    line = (F.col("base") + F.col("i") - F.col("_first") + 1).alias("line")
    text = F.when(F.col("bom") & (line == 1), F.concat(F.lit("\ufeff"), "text")).otherwise(F.col("text"))
    read = lines.rows
    if not few:
        # Dealt by block once, in a fixed number of parts: a block is never split, and its lines move a single time.
        read = read.repartition(int(lines.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *BLOCK)
    rows = read.join(F.broadcast(edges) if few else edges.hint("shuffle_hash"), BLOCK).select(*BLOCK, line, text.alias("text"), F.col("text").rlike(pattern).alias("hit"), "before", "behind")
    if not few:
        rows = rows.sortWithinPartitions(*BLOCK, "line")
    names = ["path", "line", "text", "begins", "first"]
    types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("path", "block", "line", "text", "hit", "before", "behind")), strict=True))
        held, size = [], 0
        for r in _near(each, n):
            held.append(r)
            size += len(r[2]) + 50
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    ends = edges.where(F.col("end") - F.col("upto") <= n).select("path", F.col("end").cast("long").alias("line"), F.lit("").alias("text"), F.lit(False).alias("begins"), F.lit(False).alias("first"))
    return rows.mapInArrow(run, "path string, line long, text string, begins boolean, first boolean").unionByName(ends)


def context_pieces(lines: Lines, pattern: str, n: int) -> DataFrame:
    """path, line and text of what the windows are written as: the pieces of a path, in the order of lines, are the text that ``render.format_windows`` gives of a whole file."""
    found = context_lines(lines, pattern, n)
    text = F.concat(F.when(F.col("begins") & ~F.col("first"), F.lit(BETWEEN)).otherwise(F.lit("")), pad_start(F.col("line").cast("string"), 6), F.lit(BAR), "text", F.lit("\n"))
    return found.select("path", "line", text.alias("text"))


def selected_lines(lines: Lines, spec: QuerySpec) -> Lines:
    """Without the paths that have one of the excluded strings."""
    if any("\n" in s for s in (*spec.strings, *spec.exclude_strings)):
        raise ValueError("strings across lines are searched in whole files only")
    if not spec.exclude_strings:
        return lines
    out = lines.rows.where(F.col("text").rlike(spec.exclude_pattern)).select("path").distinct()
    return Lines(lines.rows.join(out, "path", "left_anti"), lines.blocks)
