"""Every registered query with SQL, held against DuckDB over the same tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__
from tidemill.plans.queries import ORACLE_SQL, QUERIES
from tidemill.plans.views import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}") + 0.0
    if isinstance(x, decimal.Decimal):
        return float(x)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") and x.tzinfo else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_rows_left_out(spark, sf, duck):
    """Every run has a cost, and every pipeline counts."""
    n_orders, n_parts = duck.sql("SELECT (SELECT count(*) FROM orders), (SELECT count(*) FROM part)").fetchall()[0]
    assert QUERIES["k1_run_cost"](spark, sf).count() == n_orders
    assert QUERIES["r11_pipeline_summary"](spark, sf).count() == QUERIES["r12_workspace_stats"](spark, sf).first()["total_pipelines"] == n_parts
