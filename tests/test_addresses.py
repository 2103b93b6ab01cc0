"""Files addressed inside SQL."""

import json

import pytest

from tidemill.operators import checks, table
from tidemill.sources.addresses import addresses, with_files


def found(sql):
    return [(fmt, paths, options) for _, _, fmt, paths, options in addresses(sql)]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 'a.csv' FROM t WHERE x = 'a.csv' AND y IN ('b.csv', 'c.csv')",
        "SELECT trim(BOTH 'x' FROM 'a.csv'), extract(year FROM '2024-01-01'), substring('a.csv' FROM 2) FROM t",
        "SELECT a IS NOT DISTINCT FROM 'a.csv', b FROM t WHERE c IS DISTINCT FROM 'b.csv'",
        "SELECT 1 -- FROM 'a.csv'\n FROM t /* JOIN 'b.csv' */",
        "SELECT `FROM` , 'it''s FROM ''a.csv''' FROM `from 'a.csv'` ORDER BY 'a.csv', 'b.csv'",
        "SELECT * FROM t, u WHERE coalesce(a, 'x.csv') = b GROUP BY 'a.csv', 'b.csv' HAVING 'a.csv' > 'b' LIMIT 3",
        "VALUES ('a.csv'), ('b.csv')",
        "SELECT f(a, 'a.csv') FROM t LATERAL VIEW explode(split('a.csv', 'b.csv')) v AS x",
    ],
)
def test_values_stay(sql):
    assert found(sql) == []


@pytest.mark.parametrize(
    "sql, paths",
    [
        ("SELECT * FROM 'a.csv'", ["a.csv"]),
        ("select * from'a.csv'join\n'b.json' on a.x = b.x and a.y IS DISTINCT FROM 'v.csv', 'c.parquet' c", ["a.csv", "b.json", "c.parquet"]),
        ("WITH w AS (SELECT 1 FROM 'a.csv') SELECT (SELECT max(x) FROM 'b.csv' WHERE y = 'no.csv') FROM w, (SELECT * FROM ('c.csv' x CROSS JOIN 'd.csv')) z", ["a.csv", "b.csv", "c.csv", "d.csv"]),
        ("SELECT a FROM 'a.csv' UNION ALL SELECT b FROM 'b.csv'; SELECT c FROM 'c.csv'", ["a.csv", "b.csv", "c.csv"]),
        ("SELECT * FROM t WHERE x IN (SELECT y FROM 'it''s.csv') AND EXISTS (FROM 'z.csv' SELECT 1)", ["it's.csv", "z.csv"]),
        ("SELECT trim(BOTH 'x' FROM (SELECT max(v) FROM 'a.csv')) FROM LATERAL (SELECT 1 FROM 'b.csv')", ["a.csv", "b.csv"]),
    ],
)
def test_relations_are_found(sql, paths):
    assert [p for _, own, _ in found(sql) for p in own] == paths


def test_readers_with_lists_and_options():
    assert found("SELECT * FROM read_csv(['a,1.csv', 'b.csv'], delim = ';', header=false) x") == [("csv", ["a,1.csv", "b.csv"], {"delim": ";", "header": "false"})]
    assert found("SELECT read_csv('v.csv') FROM READ_PARQUET ( 'p' )") == [("parquet", ["p"], {})]
    with pytest.raises(ValueError):
        found("SELECT * FROM read_csv('a.csv'")


def test_statements_run(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("id,region,amount\n1,north,2.5\n,south,3\n3,'a.csv',4\n")
    (tmp_path / "semi.txt").write_text("id;v\n1;x\n")
    (tmp_path / "lines.json").write_text("\n" + "\n".join(json.dumps({"id": k}) for k in range(4)))
    (tmp_path / "one.json").write_text(json.dumps([{"id": k} for k in range(3)], indent=2))
    orders, run = f"{tmp_path}/orders.csv", lambda sql: [tuple(r) for r in table.run_query(spark, sql).collect()]
    assert run(f"SELECT count(*), count(orders.id), sum(amount) FROM '{orders}'") == [(3, 2, 9.5)]
    assert run(f"SELECT o.region FROM '{orders}' AS o WHERE o.region = '\\'a.csv\\''") == [("'a.csv'",)]
    assert run(f"SELECT (SELECT count(*) FROM read_json_auto('{tmp_path}/lines.json')), (SELECT count(*) FROM read_json('{tmp_path}/one.json'))") == [(4, 3)]
    assert run(f"SELECT id, v FROM read_csv('{tmp_path}/semi.txt', sep = ';')") == [(1, "x")]
    assert run(f"SELECT count(*) FROM '{tmp_path}/*.json' TABLESAMPLE (100 PERCENT)") and table.sql_summary(spark, f"SELECT * FROM '{orders}'")["row_count"] == 3
    assert with_files(spark, "SELECT 'a.csv' FROM 'no known suffix'") == "SELECT 'a.csv' FROM 'no known suffix'"
    assert spark.sql(with_files(spark, f"SELECT id FROM '{orders}'", {orders: "id string, region string, amount double"})).schema["id"].dataType.simpleString() == "string"
    with pytest.raises(ValueError, match="columns"):
        with_files(spark, f"SELECT * FROM read_csv('{orders}', columns = 'x')")


def test_checks_and_metrics_read_files(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("id,region\n1,a.csv\n,b\n")
    (tmp_path / "api_response.json").write_text('[{"id": 1}, {"id": null}]')
    orders, api = f"{tmp_path}/orders.csv", f"{tmp_path}/api_response.json"
    gate = [
        {"name": "null_ids", "sql": f"SELECT COUNT(*) FROM '{orders}' WHERE id IS NULL", "expect": 0},
        {"name": "rows", "sql": f"SELECT COUNT(*) FROM '{orders}' WHERE region <> 'a.csv'", "expect_min": 1},
        {"name": "not_empty", "sql": f"SELECT COUNT(*) FROM read_json_auto('{api}')", "expect_min": 1},
        {"name": "no_null_ids", "sql": f"SELECT COUNT(*) FROM read_json_auto('{api}') WHERE id IS NULL", "expect": 0},
        {"name": "gone", "sql": f"SELECT COUNT(*) FROM '{tmp_path}/gone.csv'", "expect": 0},
    ]
    got = {r["check_name"]: (r["passed"], r["actual_value"]) for r in checks.quality_gate(spark, gate).collect()}
    assert got == {"null_ids": (False, "1"), "rows": (True, "1"), "not_empty": (True, "2"), "no_null_ids": (False, "1"), "gone": (False, None)}
    assert {r["check"]: r["status"] for r in checks.validate(spark, gate[:1] + gate[2:3]).collect()} == {"null_ids": "failed", "not_empty": "passed"}
    assert [r["value"] for r in checks.compute_metrics(spark, [{"metric_name": "m", "sql": f"SELECT max(id) FROM '{orders}';"}]).collect()] == [1.0]
