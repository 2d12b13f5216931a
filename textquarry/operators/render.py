"""Files and windows as XML or Markdown blocks, a row each; a bundle is their ordered whole.

Fixed values: the shape of the blocks, the bar after line numbers and the mark between windows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import fence_language, pad_start, utf16_length
from textquarry.operators.windows import match_count
from textquarry.plans.spec import QuerySpec

BETWEEN = "\n  ...\n"
BAR = "│ "
FENCE = "```"


def numbered_lines(window: Column) -> Column:
    return F.array_join(F.transform(window["lines"], lambda line, i: F.concat(pad_start((window["start_line"] + i).cast("string"), 6), F.lit(BAR), line, F.lit("\n"))), "")


def format_windows(windows: Column) -> Column:
    return F.array_join(F.transform(windows, numbered_lines), BETWEEN)


def xml_file(rel: Column, content: Column) -> Column:
    return F.concat(F.lit('<file path="'), rel, F.lit('">\n'), content, F.lit("\n</file>\n\n"))


def xml_windows(rel: Column, windows: Column) -> Column:
    return F.concat(
        F.lit('<file path="'), rel, F.lit('" matches="'), match_count(windows).cast("string"), F.lit('" windows="'), F.size(windows).cast("string"), F.lit('">\n'),
        format_windows(windows), F.lit("</file>\n\n"))


def md_file(rel: Column, content: Column) -> Column:
    return F.concat(F.lit("### "), rel, F.lit(f"\n\n{FENCE}"), fence_language(rel), F.lit("\n"), content, F.lit(f"\n{FENCE}\n\n"))


def md_windows(rel: Column, windows: Column) -> Column:
    return F.concat(
        F.lit("### "), rel, F.lit("\n\n**Matches:** "), match_count(windows).cast("string"), F.lit(" | **Context windows:** "), F.size(windows).cast("string"),
        F.lit(f"\n\n{FENCE}"), fence_language(rel), F.lit("\n"), format_windows(windows), F.lit(f"{FENCE}\n\n"))


def gives_block(spec: QuerySpec) -> Column:
    """Whether a file gives a block: not one without windows where context is asked, nor one that could not be read."""
    return F.size("windows") > 0 if spec.context else F.col("content").isNotNull()


def rendered(files: DataFrame, spec: QuerySpec) -> DataFrame:
    """The files that give a block, with it. With context, files have windows. Any style but xml is Markdown."""
    rel, files = F.col("rel"), files.where(gives_block(spec))
    if spec.context:
        block = xml_windows if spec.style == "xml" else md_windows
        return files.withColumn("block", block(rel, F.col("windows")))
    block = xml_file if spec.style == "xml" else md_file
    return files.withColumn("block", block(rel, F.col("content")))


def block_size(spec: QuerySpec) -> Column:
    """UTF-16 units of a file's block, from the lengths of its parts: the block itself isn't put together. With context, files have windows with chars."""
    rel, digits = F.col("rel"), lambda n: F.length(n.cast("string"))
    if spec.context:
        block = (xml_windows if spec.style == "xml" else md_windows)(rel, F.array().cast("array<struct<n_matches:bigint,start_line:int,lines:array<string>>>"))

        def lines(w: Column) -> Column:
            count = (w["end_line"] - w["start_line"] + 1).cast("long")
            # Numbers of up to six digits are as wide as the column.
            wide = F.aggregate(F.sequence(w["start_line"], w["end_line"]), F.lit(0).cast("long"), lambda acc, i: acc + F.greatest(F.lit(6), digits(i)))
            return w["chars"] + count * (len(BAR) + 1) + F.when(w["end_line"] < 1_000_000, count * 6).otherwise(wide)

        windows = F.col("windows")
        body = F.aggregate(windows, F.lit(0).cast("long"), lambda acc, w: acc + lines(w)) + (F.size(windows) - 1) * len(BETWEEN)
        # The block without windows has a 0 in either count's place.
        counts = digits(match_count(windows)) + digits(F.size(windows)) - 2
        return F.when(gives_block(spec), utf16_length(block) + body + counts).cast("long")
    block = (xml_file if spec.style == "xml" else md_file)(rel, F.lit(""))
    return utf16_length(block) + utf16_length(F.col("content"))


def head(spec: QuerySpec, n_files: int) -> tuple[str, str]:
    """What stands before the listing of files, and what stands between that and the blocks. Markdown has no listing."""
    if spec.style == "xml":
        context = f"\n- Context lines: {spec.context} lines around each match" if spec.context else ""
        return (
            "<file_summary>\n<purpose>\nSelected files in one document.\n</purpose>\n\n<notes>\n"
            f"- Files were selected by content and extension\n- Total files included: {n_files}{context}\n</notes>\n</file_summary>\n\n<directory_structure>\n",
            "\n</directory_structure>\n\n<files>\n\n",
        )
    context = f"\n\n**Context:** {spec.context} lines around each match" if spec.context else ""
    return f"# Selected files\n\nThis document holds {n_files} files.{context}\n\n## Files\n\n", ""


def tail(spec: QuerySpec) -> str:
    return "</files>" if spec.style == "xml" else ""


def pieces(selected: DataFrame, blocks: DataFrame, spec: QuerySpec) -> DataFrame:
    """The bundle as rows of section, ord and text, which make it up in the order of section and ord."""
    spark, kind = selected.sparkSession, selected.schema["ord"].dataType
    n = selected.count()
    before, after = head(spec, n)
    if spec.style == "xml" and n:
        # Each path ends its line, so what follows the listing needs no line end before it.
        after = after.removeprefix("\n")
    lone = spark.createDataFrame([(0, before), (2, after), (4, tail(spec))], "section int, text string").select("section", F.lit(None).cast(kind).alias("ord"), "text")
    out = lone.unionByName(blocks.select(F.lit(3).alias("section"), "ord", F.col("block").alias("text")))
    if spec.style == "xml":
        out = out.unionByName(selected.select(F.lit(1).alias("section"), "ord", F.concat("rel", F.lit("\n")).alias("text")))
    return out


def bundle(selected: DataFrame, blocks: DataFrame, spec: QuerySpec) -> Iterator[str]:
    """The bundle in parts, in order, a row at a time: neither the listing nor the blocks are put together on the driver."""
    before, after = head(spec, selected.count())
    yield before
    if spec.style == "xml":
        for i, row in enumerate(selected.select("rel", "ord").orderBy("ord").toLocalIterator(prefetchPartitions=True)):
            yield "\n" * (i > 0) + row["rel"]
    yield after
    for row in blocks.select("ord", "block").orderBy("ord").toLocalIterator(prefetchPartitions=True):
        yield row["block"]
    yield tail(spec)
