import duckdb
import pytest

from tidemill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
