"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. With --duckdb, the same queries' SQL in DuckDB on as many threads instead: this repository's own baseline."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

from textquarry.plans.catalogue import ORACLES, QUERIES
from textquarry.sources.corpus import SPREAD

HEADLINE = ["contains_any_ci", "contains_one_cs", "match_positions", "context_windows_merged", "context_windows_merged_n5", "context_windows_by_rows", "render_xml_full", "render_xml_context", "summary_totals", "top10_by_tokens"]
RUNS = 3


def median_of(run: Callable[[], object]) -> float:
    run()
    runs = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        runs.append(time.perf_counter() - start)
    return round(statistics.median(runs), 3)


def in_spark(sf_dir: str, cpus: str) -> dict[str, float]:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("textquarry-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.files.maxPartitionBytes", "2m").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config(SPREAD, cpus)  # the table is one row group
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call sites, which take most of the time of building a query
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return {name: median_of(lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()) for name in HEADLINE}  # noqa: B023


def in_duckdb(sf_dir: str, cpus: str) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": cpus})
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return {name: median_of(lambda: con.execute(ORACLES[name]).to_arrow_table()) for name in HEADLINE}  # noqa: B023


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    took = (in_duckdb if "--duckdb" in sys.argv else in_spark)(sf_dir, os.environ.get("BENCH_CPUS", "8"))
    print(json.dumps({"metric": "headline queries, median of 3 warm runs, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf")}))


if __name__ == "__main__":
    main()
