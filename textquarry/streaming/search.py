"""The search over a stream of files: all its operators work within a row, so they are the same as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators.filters import select_files
from textquarry.operators.windows import match_count, with_windows
from textquarry.plans.spec import QuerySpec


def search_stream(corpus: DataFrame, spec: QuerySpec) -> DataFrame:
    """rel, start_line, end_line, n_matches of each window of each file as it arrives. corpus: a streaming DataFrame with the columns of a corpus."""
    files = with_windows(select_files(corpus, spec), spec.pattern, spec.context, lines=False, matches=False)
    return files.select("rel", F.explode("windows").alias("w")).select("rel", "w.start_line", "w.end_line", "w.n_matches")


def totals_stream(corpus: DataFrame, spec: QuerySpec) -> DataFrame:
    """Running totals, for complete or update mode."""
    files = with_windows(select_files(corpus, spec), spec.pattern, spec.context, lines=False, matches=False)
    return files.groupBy().agg(F.count("*").alias("total_files"), F.sum(match_count(F.col("windows"))).alias("total_matches"), F.sum(F.size("windows")).cast("long").alias("total_windows"))
