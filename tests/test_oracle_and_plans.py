"""Every registered query against its DuckDB oracle, and the shape of the physical plans."""

import os
import sys

import pytest

from conftest import ROOT, SF01

sys.path.insert(0, os.path.join(ROOT, "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_oracle import rows_of  # noqa: E402

QUERIES = queries()
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from rosterspark.sources.fixtures import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns[:2] == ["domain", "total"]


def test_every_contact_query_has_an_oracle():
    from rosterspark.plans import catalog, oracle_sql

    assert set(catalog.QUERIES) == set(oracle_sql.ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF01).toPandas()
    want = duck.execute(ORACLE[name]).fetchdf()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"delivery_stub", "stream_validate", "stream_dedup",
                                                       "stream_progress", "csv_contacts", "csv_quarantine"}))
def test_no_cross_join_in_plan(spark, name):
    plan = QUERIES[name](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in plan, (name, bad)


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from rosterspark.sources import fixtures

    c = fixtures.contacts(spark, SF01)
    q = c.filter(F.col("line_number") > 100).select("email")
    text = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(line_number), GreaterThan(line_number,100)]" in text
    assert "ReadSchema: struct<line_number:bigint,email:string>" in text


def test_dedup_window_is_partitioned(spark):
    text = QUERIES["dup_email"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text


@pytest.mark.parametrize("name", ["progress_timeline", "phase_intervals", "session_progress", "sessions_export",
                                  "retry_plan", "session_diff"])
def test_time_queries_do_not_depend_on_session_time_zone(spark, duck, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = QUERIES[name](spark, SF01).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    want = duck.execute(ORACLE[name]).fetchdf()
    assert rows_of(got) == rows_of(want)
