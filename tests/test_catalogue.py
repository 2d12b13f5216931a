"""Every query against its SQL."""

import math

import duckdb
import pytest

from textquarry.plans import catalogue

TABLES = "documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in values), key=repr)


def test_each_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, data, name):
    df = catalogue.QUERIES[name](spark, data)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cur.fetchall())


def test_search_stays_in_the_scan_stage(spark, data):
    plan = catalogue.QUERIES["context_windows_merged"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    # Windows are computed once, whatever reads them.
    for name in ("context_windows_merged", "summary_totals", "top10_by_tokens", "render_xml_context", "windows_per_doc"):
        assert catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString().count("split(") == 1, name
    plan = catalogue.QUERIES["contains_one_cs"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,license)" in plan
