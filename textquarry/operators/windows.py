"""Matches by line, and windows of context around them, within each row: no shuffle, and usable on streams.

A window is struct<start_line, end_line, n_matches> and, as asked, chars (UTF-16
units of its lines), lines, and matches: struct<line, column, match>, lines from 1,
columns from 0 in UTF-16 units. What isn't asked isn't built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.arrays import let, once, running
from textquarry.functions.text import utf16_length


#: Matches of a line that are placed one by one.
FEW = 6


def split_lines(content: Column) -> Column:
    """Lines by newline alone; a last empty one counts."""
    return F.split(content, "\n", -1)


def hits(line: Column, pattern: str) -> Column:
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def line_matches(line: Column, number: Column, pattern: str) -> Column:
    """All matches of one line, null without any. Gaps and hits alternate, so a column is the length of all that stands before."""

    def placed(p: Column) -> Column:
        sizes = F.zip_with(F.slice(p["g"], F.lit(1), F.size(p["h"])), p["h"], lambda g, h: F.struct(utf16_length(g).alias("g"), utf16_length(h).alias("n")))

        def columns(s: Column) -> Column:
            before = running(F.transform(s, lambda x: x["g"] + x["n"]), lambda a, x: a + x, F.lit(0).cast("long"))
            return let(before, lambda b: F.transform(p["h"], lambda h, i: F.struct(number.cast("int").alias("line"), (F.get(b, i) + F.get(s, i)["g"]).cast("int").alias("column"), h.alias("match"))))

        # Of a few matches each adds up what stands before it, which is less work than a running sum.
        before = lambda of, i: utf16_length(F.array_join(F.slice(of, F.lit(1), i), ""))
        few = F.transform(p["h"], lambda h, i: F.struct(number.cast("int").alias("line"), (before(p["g"], i + 1) + before(p["h"], i)).cast("int").alias("column"), h.alias("match")))
        return F.when(F.size(p["h"]) <= FEW, few).otherwise(let(sizes, columns))

    # A line without a match is a single gap, and isn't searched again for hits.
    return let(F.split(line, pattern, -1), lambda g: F.when(F.size(g) > 1, let(F.struct(g.alias("g"), hits(line, pattern).alias("h")), placed)))


def positions(files: DataFrame, pattern: str, *keep: str) -> DataFrame:
    """The columns to keep and line, column, match of each match in each content: a row a line first, so that lines without a match go at once."""
    lines = files.select(*keep, F.posexplode(split_lines(F.col("content"))).alias("_i", "_text")).where(F.col("_text").rlike(pattern))
    return lines.select(*keep, F.explode(line_matches(F.col("_text"), F.col("_i") + 1, pattern)).alias("_m")).select(*keep, "_m.line", "_m.column", "_m.match")


def match_positions(content: Column, pattern: str) -> Column:
    """All matches of all lines, in order."""
    per_line = F.transform(split_lines(content), lambda line, i: line_matches(line, i + 1, pattern))
    return F.flatten(F.filter(per_line, lambda x: x.isNotNull()))


def context_windows(content: Column, pattern: str, n: int, chars: bool = False, lines: bool = True, matches: bool = True) -> Column:
    """Windows of n lines around each match; those that touch or overlap are one. chars, lines, matches: the fields that windows have beside bounds and counts.

    Windows are as wide as their gaps are narrow: a new one starts where two
    matching lines are more than 2n + 1 apart, at the edges of the file too.
    """

    def of_lines(of: Column) -> Column:
        def found_in(line: Column, i: Column) -> Column:
            if not matches:
                return F.struct((i + 1).alias("line"), F.regexp_count(line, F.lit(pattern)).alias("n"))
            return let(line_matches(line, i + 1, pattern), lambda m: F.struct((i + 1).alias("line"), F.coalesce(F.size(m), F.lit(0)).alias("n"), m.alias("matches")))

        found = F.filter(F.transform(of, found_in), lambda x: x["n"] > 0)

        def windows(m: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i)["line"] - F.get(m, i - 1)["line"] > 2 * n + 1))

            def cut(s: Column) -> Column:
                def one(at: Column, j: Column) -> Column:
                    last = F.coalesce(F.get(s, j + 1), F.size(m)) - 1
                    start = F.greatest(F.lit(1), F.get(m, at)["line"] - n)
                    end = F.least(F.size(of), F.get(m, last)["line"] + n)
                    own = F.slice(m, at + 1, last - at + 1)
                    here = F.slice(of, start, end - start + 1)
                    out = [start.alias("start_line"), end.alias("end_line"), F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("n_matches")]
                    if chars:
                        out.append(F.aggregate(here, F.lit(0).cast("long"), lambda acc, x: acc + utf16_length(x)).alias("chars"))
                    if lines:
                        out.append(here.alias("lines"))
                    if matches:
                        out.append(F.flatten(F.transform(own, lambda x: x["matches"])).alias("matches"))
                    return F.struct(*out)

                return F.transform(s, one)

            return F.when(F.size(m) > 0, let(starts, cut))

        return let(found, windows)

    return F.coalesce(let(split_lines(content), of_lines), F.array())


def with_windows(files: DataFrame, pattern: str, n: int, **fields: bool) -> DataFrame:
    return once(files, "windows", context_windows(F.col("content"), pattern, n, **fields))


def match_count(windows: Column) -> Column:
    return F.aggregate(windows, F.lit(0).cast("long"), lambda acc, w: acc + w["n_matches"])


def windows_by_rows(files: DataFrame, key: str, pattern: str, n: int) -> DataFrame:
    """The same windows from rows of matching lines: key, start_line, end_line, n_matches. One shuffle of numbers, for files of very many lines."""
    content = F.col("content")
    n_lines = (F.octet_length(content) - F.octet_length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).alias("n_lines")
    lines = files.select(key, n_lines, F.posexplode(split_lines(content)).alias("i", "text"))
    found = lines.where(F.col("text").rlike(pattern)).select(key, (F.col("i") + 1).alias("line"), F.regexp_count("text", F.lit(pattern)).cast("long").alias("n"), "n_lines")
    w = Window.partitionBy(key).orderBy("line")
    new = F.coalesce((F.col("line") - F.lag("line").over(w) > 2 * n + 1).cast("int"), F.lit(1))
    island = found.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(
        F.greatest(F.lit(1), F.min("line") - n).alias("start_line"), F.least(F.first("n_lines"), F.max("line") + n).alias("end_line"), F.sum("n").alias("n_matches")).drop("island")
