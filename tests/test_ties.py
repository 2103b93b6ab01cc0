"""Queries over events of equal times, held against their SQL."""

import datetime as dt

import duckdb
import pytest

from tests.test_queries import rows
from tidemill.operators import runs
from tidemill.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Runs of three events of one time each, in all orders of their types, some without time, value or details."""
    kinds, at = ("click", "view", "signup", "purchase", "error", "error"), dt.datetime(2024, 1, 1)
    events = [
        (3 * n + k, None if n % 11 == 10 else at + dt.timedelta(days=n % 2), kinds[(n // 6**k) % 6], None if n % 5 == 0 else float(k), None if (n + k) % 7 == 0 else f"d{(n * 7 + k) % 4}")
        for n in range(216)
        for k in range(3)
    ]
    folder = str(tmp_path_factory.mktemp("tied"))
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, event_type string, value double, props string").repartition(5).write.parquet(f"{folder}/events.parquet")
    return folder


def agrees(spark, folder, name):
    df, con = QUERIES[name](spark, folder), duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["r1_latest_by_pipeline", "r2_latest_by_run"])
def test_latest_rows_of_equal_times(spark, tied, name):
    agrees(spark, tied, name)


def test_states_of_equal_times(spark, tied):
    agrees(spark, tied, "r17_fold_run_state")
    rows = [("r", p, "failed", 1, e) for p, e in (("p", "a"), ("q", "b"), ("o", "b"))]
    for order in (rows, rows[::-1]):
        last = runs.fold_run_state(spark.createDataFrame(order, "run_id string, pipeline_name string, status string, updated_at int, error string").coalesce(1)).first()
        assert (last["error"], last["pipeline_name"]) == ("b", "q")
