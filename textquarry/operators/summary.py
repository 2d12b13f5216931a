"""What a search found, in numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import extension, short_path, token_estimate
from textquarry.operators.windows import match_count

TOP = 10


def file_sizes(sized: DataFrame) -> DataFrame:
    """rel, ord, size and tokens of each of sized."""
    return sized.select("rel", "ord", "size").withColumn("tokens", token_estimate(F.col("size")))


def totals(sized: DataFrame) -> DataFrame:
    """One row of one pass: files selected, matches, windows, characters of blocks, tokens (of the sum, not a sum of tokens)."""
    counts = [F.sum(match_count(F.col("windows"))), F.sum(F.size("windows"))] if "windows" in sized.columns else [F.lit(0), F.lit(0)]
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = sized.agg(F.count("*").alias("total_files"), whole(counts[0]).alias("total_matches"), whole(counts[1]).alias("total_windows"), whole(F.sum("size")).alias("total_chars"))
    return out.withColumn("total_tokens", token_estimate(F.col("total_chars")))


def extensions_found(selected: DataFrame) -> DataFrame:
    ext = F.lower(extension(F.col("rel")))
    return selected.select(ext.alias("ext")).where("ext <> ''").distinct()


def top_files(sizes: DataFrame, n: int = TOP) -> DataFrame:
    return sizes.orderBy(F.desc("tokens"), F.asc("ord")).limit(n).select(short_path(F.col("rel")).alias("rel"), "tokens", "ord")
