"""Registered queries, one or more for each operator, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import registry
from tidemill.operators import checks, definitions, lineage, runs, table, versions
from tidemill.plans.server import rows_served
from tidemill.plans.views import oracle, spark_text, view
from tidemill.plans.views import table as source
from tidemill.sources import external, files, history, loads, requests
from tidemill.sources.scratch import scratch_dir, stored
from tidemill.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register fn(spark, dir, *view frames)."""

    def add(fn):
        QUERIES[name] = lambda spark, d: fn(spark, d, *[view(spark, d, v) for v in views])
        if sql:
            ORACLE_SQL[name] = oracle(sql, *views)
        return fn

    return add


def sql_query(name: str, text: str, duck: str | None = None, *tables: str) -> None:
    """Register a SQL text that both engines read (or its DuckDB form) over tables."""
    QUERIES[name] = lambda spark, d: table.run_query(spark, text, {t: source(spark, d, t) for t in tables})
    ORACLE_SQL[name] = duck or text


REPORT = "CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS total_revenue, CAST(sum(CAST(quantity AS DECIMAL(18,4))) AS DOUBLE) AS total_quantity, count(*) AS orders, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_revenue"

#: A file's path for each supplier, in folders of a thousand.
_SUPPLIER_FILE = "concat('thousand=', s_suppkey div 1000, '/s_suppkey=', s_suppkey, '.txt') AS path"

# --- sources and sinks -------------------------------------------------------------------------


@query("s1_csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    path = scratch_dir(spark, "csv")
    files.write_sink(source(spark, d, "nation"), path, "csv")
    return files.read_source(spark, path, "csv")


@query("s2_register_sources", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    files.register_sources(spark, {"src_nation": f"{d}/nation.parquet", "src_region": {"path": f"{d}/region.parquet", "format": "parquet"}})
    return spark.sql("SELECT n_name, r_name FROM src_nation JOIN src_region ON n_regionkey = r_regionkey")


def _nations_as_files(spark, d) -> tuple[str, str]:
    folder = scratch_dir(spark, "addressed")
    files.write_sink(source(spark, d, "supplier"), f"{folder}/suppliers.csv", "csv")
    files.write_sink(source(spark, d, "nation"), f"{folder}/nations.json", "json")
    return f"{folder}/suppliers.csv", f"{folder}/nations.json"


@query("s2_files_in_sql", "SELECT n_name, count(*) AS suppliers, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d):
    csv, json = _nations_as_files(spark, d)
    sql = f"SELECT n.n_name, count(*) AS suppliers, CAST(sum(CAST(suppliers.s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM '{csv}', read_json_auto('{json}') n WHERE s_nationkey = n_nationkey AND s_name IS DISTINCT FROM 'a.csv' GROUP BY n.n_name"
    return table.run_query(spark, sql)


@query("t9_files_in_sql", "SELECT 'not_empty' AS check_name, count(*) > 0 AS passed, count(*)::VARCHAR AS actual_value, NULL AS error FROM supplier UNION ALL SELECT 'no_null_ids', count(*) FILTER (s_suppkey IS NULL) = 0, count(*) FILTER (s_suppkey IS NULL)::VARCHAR, NULL FROM supplier UNION ALL SELECT 'nations', count(*) = 25, count(*)::VARCHAR, NULL FROM nation UNION ALL SELECT 'missing_file', false, NULL, 'PATH_NOT_FOUND'")
def _(spark, d):
    csv, json = _nations_as_files(spark, d)
    gate = [
        {"name": "not_empty", "sql": f"SELECT COUNT(*) FROM '{csv}'", "expect_min": 1},
        {"name": "no_null_ids", "sql": f"SELECT COUNT(*) FROM '{csv}' WHERE s_suppkey IS NULL", "expect": 0},
        {"name": "nations", "sql": f"SELECT COUNT(*) FROM read_json_auto('{json}')", "expect": 25},
        {"name": "missing_file", "sql": f"SELECT COUNT(*) FROM '{csv}-none.parquet'", "expect_min": 0},
    ]
    return checks.quality_gate(spark, gate).select("check_name", "passed", "actual_value", F.nullif(F.regexp_extract("error", r"\[(\w+)\]", 1), F.lit("")).alias("error"))


@query("s3_generic_scan", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, d):
    return files.read_source(spark, f"{d}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("s4_write_sink", "SELECT (SELECT count(*) FROM orders) AS rows_written, o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    path = scratch_dir(spark, "sink")
    n = files.write_sink(source(spark, d, "orders"), path, "orc")
    return files.read_source(spark, path, "orc").select(F.lit(n).cast("long").alias("rows_written"), "o_orderkey", "o_orderstatus", "o_totalprice")


@query("s5_export_csv", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    path = scratch_dir(spark, "export")
    files.export_csv(source(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")), path, [F.desc("n")])
    return files.read_source(spark, path, "csv", "status string, n long")


@query("s12_warehouse_ddl", "SELECT 'c_custkey' AS name, 'INTEGER' AS type UNION ALL SELECT 'c_acctbal', 'FLOAT' UNION ALL SELECT 'c_name', CASE WHEN max(length(c_name)) <= 255 THEN 'VARCHAR(255)' WHEN max(length(c_name)) <= 1000 THEN 'VARCHAR(1000)' ELSE 'VARCHAR(4000)' END FROM customer UNION ALL SELECT 'text', CASE WHEN max(length(text)) <= 255 THEN 'VARCHAR(255)' WHEN max(length(text)) <= 1000 THEN 'VARCHAR(1000)' ELSE 'VARCHAR(4000)' END FROM documents")
def _(spark, d):
    rows = external.warehouse_ddl(source(spark, d, "customer").select("c_custkey", "c_acctbal", "c_name")) + external.warehouse_ddl(source(spark, d, "documents").select("text"))
    return spark.createDataFrame(rows, "name string, type string")


def _database(name: str) -> dict:
    """A database in the memory of the driver's JVM: tables are written and read by JDBC there, so these queries are for local sessions."""
    return {"url": f"jdbc:derby:memory:{name}_{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@query("s6_jdbc_query", "SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
def _(spark, d):
    conn = _database("s6")
    external.jdbc_load(source(spark, d, "customer"), conn, "customer", "overwrite")
    sql = 'SELECT "c_nationkey", "c_acctbal" FROM "customer" WHERE "c_acctbal" > 0'
    return external.jdbc_query(spark, conn, sql, "c_nationkey", 0, 25, 4).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))


@query("s6_balanced_splits", "SELECT o_orderpriority, count(*) AS orders, true AS balanced FROM orders GROUP BY 1")
def _(spark, d):
    """Splits planned by rows of a skewed key: none holds over twice the mean."""
    conn = _database("s6b")
    external.jdbc_load(source(spark, d, "orders").select(F.pow(F.col("o_orderkey").cast("double"), 4).alias("k"), "o_orderpriority"), conn, "orders", "overwrite", createTableColumnTypes="o_orderpriority VARCHAR(20)")
    read = external.jdbc_query(spark, conn, 'SELECT * FROM "orders"', "k", partitions=8)
    parts = stored(read.groupBy("o_orderpriority", F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")))
    balance = parts.groupBy("part").agg(F.sum("n").alias("n")).agg((F.max("n") <= 2 * F.sum("n") / 8).alias("balanced"), F.lit(1).alias("one"))
    return parts.groupBy("o_orderpriority").agg(F.sum("n").alias("orders"), F.lit(1).alias("one")).join(balance, "one").drop("one")


@query("s7_jdbc_load", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal < 0")
def _(spark, d):
    conn, path, rows = _database("s7"), scratch_dir(spark, "csv"), source(spark, d, "supplier")
    files.export_csv(rows, path)
    loaded = files.read_source(spark, path, "csv", rows.schema)
    external.jdbc_load(loaded, conn, "Odd Schema.sup plier", "overwrite", partitions=2)
    external.jdbc_load(loaded.filter("s_acctbal < 0"), conn, "Odd Schema.sup plier")
    return external.jdbc_query(spark, conn, 'SELECT * FROM "Odd Schema"."sup plier"')


@query("s7_load_whole", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey < 20")
def _(spark, d):
    """A second load holds keys that the target does not take, so it leaves no row."""
    conn, rows = _database("s7w"), source(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    external.jdbc_load(rows.filter("c_nationkey < 20"), conn, "customer", "overwrite", createTableColumnTypes="c_name VARCHAR(40)")
    loads.transaction(spark, conn["url"], conn, ['ALTER TABLE "customer" ADD CHECK ("c_nationkey" < 20)'])
    try:
        external.jdbc_load(rows.filter("c_nationkey >= 10"), conn, "customer", partitions=4)
    except Py4JJavaError:
        return external.jdbc_query(spark, conn, 'SELECT * FROM "customer"')
    raise AssertionError("the load should have failed")


@query("s8_jdbc_extract", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 10")
def _(spark, d):
    conn, path = _database("s8"), scratch_dir(spark, "extract")
    external.jdbc_load(source(spark, d, "supplier"), conn, "supplier", "overwrite")
    external.jdbc_extract(spark, conn, 'SELECT "s_suppkey", "s_name" FROM "supplier" WHERE "s_nationkey" < 10', path)
    return files.read_source(spark, path, "csv", "s_suppkey long, s_name string")


@query("s11_warehouse_load", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0")
def _(spark, d):
    conn, rows = _database("s11"), source(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    external.warehouse_load(rows, conn, "loaded", "replace")
    external.warehouse_load(rows.filter("c_acctbal < 0"), conn, "loaded", "append")
    return external.jdbc_query(spark, conn, "SELECT * FROM loaded")


@query("s16_kafka_encode", """SELECT CAST(o_orderkey AS VARCHAR) AS key, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS value, 0 AS partition FROM orders""")
def _(spark, d):
    return external.kafka_encode(source(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 0)


@query("s17_kafka_decode", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, d):
    sent = external.kafka_encode(source(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    return external.kafka_decode(sent, "o_orderkey long, o_orderstatus string, o_totalprice double").select("value.*")


@query("s18_http_requests", "SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN s_name END AS s_name, CASE WHEN s_acctbal >= 0 THEN 200 ELSE 404 END AS status, CASE WHEN s_acctbal >= 0 AND s_suppkey % 10 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN s_acctbal >= 0 AND s_suppkey % 10 = 0 THEN 2 ELSE 1 END AS served FROM supplier")
def _(spark, d):
    """Rows of a table from a server in the driver, so for local sessions: a tenth fails at first, those of negative balance are not found."""
    rows = source(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    with rows_served({r["s_suppkey"]: (r["s_name"], r["s_acctbal"]) for r in rows.toLocalIterator()}) as (base, served):
        asked = rows.select(F.lit(f"{base}/supplier").alias("url"), F.create_map(F.lit("key"), F.col("s_suppkey").cast("string")).alias("params"))
        got = stored(requests.fetch_all(spark, asked.unionByName(asked), scratch_dir(spark, "answers"), per_task=200, wait=0.1))
        counted = spark.createDataFrame(list(served.items()), "s_suppkey long, served int")
    key = F.regexp_extract("url", r"key=(\d+)", 1).cast("long").alias("s_suppkey")
    return got.select(key, F.get_json_object("body", "$.s_name").alias("s_name"), "status", "attempts").join(counted, "s_suppkey")


@query("s19_read_text_files", "SELECT s_suppkey::INT AS s_suppkey, s_name || chr(10) || s_nationkey || chr(10) AS content, length(s_name) + length(s_nationkey::VARCHAR) + 2 AS size FROM supplier")
def _(spark, d):
    folder = scratch_dir(spark, "whole")
    files.write_text_files(source(spark, d, "supplier").select(F.expr(_SUPPLIER_FILE), F.concat(F.concat_ws("\n", "s_name", "s_nationkey"), F.lit("\n")).alias("content")), folder)
    return files.read_text_files(spark, folder).select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("int").alias("s_suppkey"), "content", "size")


@query("s21_list_files", "SELECT o_orderstatus AS folder, sum(length(o_orderkey::VARCHAR) + 1)::BIGINT AS bytes FROM orders GROUP BY 1")
def _(spark, d):
    folder = scratch_dir(spark, "listed")
    source(spark, d, "orders").select("o_orderstatus", F.col("o_orderkey").cast("string")).write.partitionBy("o_orderstatus").text(folder)
    return files.list_files(spark, folder, "*.txt", True).groupBy(F.regexp_extract("path", "o_orderstatus=([^/]*)", 1).alias("folder")).agg(F.sum("size").alias("bytes"))


@query("s22_write_text", "SELECT r_name AS value FROM region UNION ALL SELECT n_name FROM nation")
def _(spark, d):
    folder = scratch_dir(spark, "lines")
    files.write_text(source(spark, d, "region").select("r_name"), folder)
    files.write_text(source(spark, d, "nation").select("n_name"), folder, "append")
    return spark.read.text(folder)


@query("s20_merge_files", "SELECT value, count(*) AS n FROM (SELECT p_name AS value FROM part UNION ALL SELECT s_name FROM supplier) GROUP BY value")
def _(spark, d):
    a, b, out = (scratch_dir(spark, "text") for _ in range(3))
    files.write_text(source(spark, d, "part").select("p_name"), a)
    files.write_text(source(spark, d, "supplier").select("s_name"), b)
    files.merge_files(spark, [a, b, f"{a}-missing"], out)
    return spark.read.text(out).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("s23_append_history", "SELECT event_id, event_type, actor, CAST(occurred_at AS DATE) AS date FROM audit", "audit")
def _(spark, d, audit):
    folder = scratch_dir(spark, "history")
    files.append_history(audit.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")), folder, "audit_log")
    return files.read_history(spark, folder, "audit_log").select("event_id", "event_type", "actor", "date")


@query("s23_append_once", "SELECT event_id, event_type, actor, CAST(occurred_at AS DATE) AS date FROM audit", "audit")
def _(spark, d, audit):
    """Three batches, each sent twice."""
    folder, rows = scratch_dir(spark, "history"), audit.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    for k in range(3):
        part = rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k)
        for _ in range(2):
            history.append_once(part, folder, "audit_log", "replayed", k)
    return files.read_history(spark, folder, "audit_log").select("event_id", "event_type", "actor", "date")


@query("s24_bind_inputs", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, d):
    files.bind_inputs(spark, {"step_nations": source(spark, d, "nation"), "step_regions": source(spark, d, "region")})
    return spark.sql("SELECT r_name, count(*) AS n FROM step_nations JOIN step_regions ON n_regionkey = r_regionkey GROUP BY r_name")


# --- table operators ---------------------------------------------------------------------------


@query("t1_profile", "SELECT 'o_orderkey' AS \"column\", 'bigint' AS type, count(*) AS rows, count(*) - count(o_orderkey) AS nulls FROM orders UNION ALL SELECT 'o_custkey', 'bigint', count(*), count(*) - count(o_custkey) FROM orders UNION ALL SELECT 'o_orderpriority', 'string', count(*), count(*) - count(o_orderpriority) FROM orders")
def _(spark, d):
    return table.profile_columns(source(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))


@query("t2_query", "SELECT category, region, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM sales WHERE quantity > 10 AND discount_pct <> 0 GROUP BY category, region", "sales")
def _(spark, d, sales):
    return table.run_query(spark, "SELECT category, region, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM data WHERE quantity > 10 AND discount_pct <> 0 GROUP BY category, region", {"data": sales})


@query("t3_aggregate", "SELECT category, year(sale_date)::INT AS year, count(*) AS count_rows, CAST(sum(CAST(quantity AS DECIMAL(18,2))) AS DOUBLE) AS units, min(unit_price) AS min_unit_price, max(unit_price) AS max_unit_price, count(DISTINCT product) AS products FROM sales GROUP BY 1, 2", "sales")
def _(spark, d, sales):
    out = table.aggregate(sales, ["category", {"expr": "year(sale_date)", "alias": "year"}], [{"alias": "count_rows"}, {"column": "CAST(quantity AS DECIMAL(18,2))", "function": "SUM", "alias": "units"}, {"column": "unit_price", "function": "min"}, {"column": "unit_price", "function": "max"}, {"column": "DISTINCT product", "function": "count", "alias": "products"}], ["units DESC", "category"])
    return out.withColumn("units", F.col("units").cast("double"))


@query("t3a_aggregates", "SELECT region, sum(CAST(line_no AS BIGINT))::BIGINT AS sum_line_no, avg(line_no) AS avg_line_no, count(line_no) AS count_line_no, min(line_no) AS min_line_no, max(line_no) AS max_line_no FROM sales GROUP BY region", "sales")
def _(spark, d, sales):
    return table.aggregate(sales, ["region"], [{"column": "line_no", "function": f} for f in ("sum", "avg", "count", "min", "max")])


CHECKS = [
    {"name": "rows", "sql": "SELECT count(*) FROM data", "expect_gt": 0},
    {"name": "blank_regions", "table": "data", "where": "region IS NULL OR trim(region) = ''", "expect": 0},
    {"name": "non_positive_revenue", "table": "data", "where": "revenue <= 0", "expect": 0},
    {"name": "discount_range", "table": "data", "where": "discount_pct < 0 OR discount_pct > 0.05", "expect_lt": 1},
    {"name": "regions", "sql": "SELECT count(DISTINCT region) FROM data", "expect": 5},
    {"name": "no_expectation", "sql": "SELECT min(line_no) FROM data"},
    {"name": "null_bound", "sql": "SELECT max(line_no) FROM data WHERE line_no < 0", "expect_gt": 0},
]
_CHECKED = """SELECT 'rows' AS n, count(*) AS v, count(*) > 0 AS ok FROM sales UNION ALL SELECT 'blank_regions', count(*) FILTER (region IS NULL OR trim(region) = ''), count(*) FILTER (region IS NULL OR trim(region) = '') = 0 FROM sales
UNION ALL SELECT 'non_positive_revenue', count(*) FILTER (revenue <= 0), count(*) FILTER (revenue <= 0) = 0 FROM sales UNION ALL SELECT 'discount_range', count(*) FILTER (discount_pct < 0 OR discount_pct > 0.05), count(*) FILTER (discount_pct < 0 OR discount_pct > 0.05) < 1 FROM sales
UNION ALL SELECT 'regions', count(DISTINCT region), count(DISTINCT region) = 5 FROM sales UNION ALL SELECT 'no_expectation', min(line_no), true FROM sales UNION ALL SELECT 'null_bound', NULL, false"""


@query("t4_validate", f'SELECT n AS "check", CAST(v AS VARCHAR) AS actual, CASE WHEN ok THEN \'passed\' ELSE \'failed\' END AS status, n = \'null_bound\' AS has_error FROM ({_CHECKED})', "sales")
def _(spark, d, sales):
    return checks.validate(spark, [*CHECKS, {"name": "skipped"}], {"data": sales}).withColumn("has_error", F.col("error").isNotNull()).drop("error")


@query("t4_validate_totals", f"SELECT count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) AS total FROM ({_CHECKED})", "sales")
def _(spark, d, sales):
    return checks.totals(checks.validate(spark, CHECKS, {"data": sales}))


@query("t5_transform", "SELECT order_id, line_no, quantity, quantity * 2 AS twice, quantity > 25 AS large, CASE WHEN discount_pct >= 0.05 THEN 'deal' ELSE 'list' END AS band FROM sales", "sales")
def _(spark, d, sales):
    return table.transform(sales.select("order_id", "line_no", "quantity", "discount_pct"), [{"name": "twice", "sql": "quantity * 2"}, {"name": "large", "sql": "quantity > 25"}, {"name": "band", "sql": "CASE WHEN discount_pct >= 0.05 THEN 'deal' ELSE 'list' END"}, {"name": "dropped"}]).drop("discount_pct")


@query("t6_materialize", "SELECT region, count(*) AS n FROM sales GROUP BY region HAVING count(*) > 1", "sales")
def _(spark, d, sales):
    table.materialize(sales.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "by_region")
    return spark.sql("SELECT region, n FROM by_region WHERE n > 1")


@query("t7_sql_summary", "SELECT count(*) AS row_count, 'o_orderkey,o_totalprice' AS columns FROM orders WHERE o_totalprice > 1000")
def _(spark, d):
    s = table.sql_summary(spark, "SELECT o_orderkey, o_totalprice FROM data WHERE o_totalprice > 1000", {"data": source(spark, d, "orders")})
    return spark.createDataFrame([(s["row_count"], ",".join(s["columns"]))], "row_count long, columns string")


@query("t8_transform_path", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    out = scratch_dir(spark, "step")
    table.transform_path(spark, f"{d}/lineitem.parquet", out, sql="SELECT l_returnflag, count(*) AS n FROM input_data GROUP BY 1")
    return spark.read.parquet(out)


GATE = [
    {"name": "rows", "sql": "SELECT count(*) FROM data", "expect_min": 1},
    {"name": "regions", "sql": "SELECT count(DISTINCT region) FROM data", "expect": "5"},
    {"name": "discounts", "sql": "SELECT max(discount_pct) FROM data", "expect_min": 0.0, "expect_max": 0.01},
    {"name": "text_under_bounds", "sql": "SELECT min(region) FROM data", "expect_min": 0},
    {"name": "text_equal", "sql": "SELECT min(region) FROM data", "expect": "AFRICA"},
    {"name": "any", "sql": "SELECT max(line_no) FROM data"},
]


@query("t9_quality_gate", """SELECT 'run_1' AS run_id, 'sales' AS pipeline_name, 'load' AS task_name, n AS check_name, ok AS passed, e AS expected_value, v AS actual_value, CAST(NULL AS VARCHAR) AS error FROM (
SELECT 'rows' AS n, count(*) >= 1 AS ok, '>= 1' AS e, count(*)::VARCHAR AS v FROM sales UNION ALL SELECT 'regions', count(DISTINCT region) = 5, '== 5', count(DISTINCT region)::VARCHAR FROM sales UNION ALL SELECT 'discounts', max(discount_pct) BETWEEN 0 AND 0.01, '>= 0.0 and <= 0.01', max(discount_pct)::VARCHAR FROM sales
UNION ALL SELECT 'text_under_bounds', false, '>= 0', min(region) FROM sales UNION ALL SELECT 'text_equal', min(region) = 'AFRICA', '== AFRICA', min(region) FROM sales UNION ALL SELECT 'any', true, 'any', max(line_no)::VARCHAR FROM sales)""", "sales")
def _(spark, d, sales):
    return checks.quality_gate(spark, GATE, {"data": sales}, "run_1", "sales", "load").drop("checked_at")


@query("t10_rule_check", "SELECT f AS field, r AS rule, v AS violations, v = 0 AS passed FROM (SELECT 'c_name' AS f, 'not_null' AS r, count(*) FILTER (c_name IS NULL) AS v FROM customer UNION ALL SELECT 'c_acctbal', 'positive', count(*) FILTER (NOT c_acctbal > 0) FROM customer)")
def _(spark, d):
    return checks.rule_check(source(spark, d, "customer"), [{"field": "c_name", "type": "not_null"}, {"field": "c_acctbal", "type": "positive"}])


_TITLE = "array_to_string(list_transform(string_split(region, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("t11_curate_orders", f"SELECT order_id, customer, {_TITLE} AS region, amount, status, CASE WHEN amount >= 100000 THEN 'high' ELSE 'standard' END AS priority FROM demo_orders", "demo_orders")
def _(spark, d, orders):
    return table.curate_orders(orders, 100000)


@query("t12_sales_summary", f"""WITH c AS (SELECT {_TITLE} AS region, amount FROM demo_orders) SELECT 'total' AS scope, 'row_count' AS name, count(*)::DOUBLE AS value FROM c UNION ALL SELECT 'total', 'total_revenue', CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM c
UNION ALL SELECT 'total', 'high_priority_orders', count(*) FILTER (amount >= 100000) FROM c UNION ALL SELECT 'region', region, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM c GROUP BY region""", "demo_orders")
def _(spark, d, orders):
    return table.sales_summary(table.curate_orders(orders, 100000))


@query("t13_reconcile_counts", "SELECT count(*) AS left_rows, count(*) AS right_rows, 'ok' AS status FROM demo_orders", "demo_orders")
def _(spark, d, orders):
    return table.reconcile_counts(orders, table.curate_orders(orders))


@query("t14_sales_kpis", "SELECT order_id, line_no, quantity * unit_price AS gross_amount, quantity * unit_price * discount_pct AS discount_amount, quantity * unit_price * (1 - discount_pct) AS net_amount, revenue / nullif(quantity, 0) AS revenue_per_unit FROM sales", "sales")
def _(spark, d, sales):
    return table.sales_kpis(sales).select("order_id", "line_no", "gross_amount", "discount_amount", "net_amount", "revenue_per_unit")


@query("t15_revenue_by_category", f"SELECT category, {REPORT} FROM sales GROUP BY category", "sales")
def _(spark, d, sales):
    return table.revenue_by_category(sales)


@query("t16_revenue_by_region_quarter", f"SELECT region, quarter, {REPORT} FROM sales GROUP BY region, quarter", "sales")
def _(spark, d, sales):
    return table.revenue_by_region_quarter(sales)


@query("t17_top_products", f"SELECT product, category, {REPORT} FROM sales GROUP BY product, category ORDER BY total_revenue DESC, product, category LIMIT 10", "sales")
def _(spark, d, sales):
    return table.top_products(sales)


_SECTION = "SELECT '{0}' AS section, CAST({0} AS VARCHAR) AS name, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS value FROM sales GROUP BY {0}"


@query("t18_executive_report", f"""WITH t AS (SELECT CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS total, count(*) AS n FROM sales), s AS ({' UNION ALL '.join(_SECTION.format(c) for c in ('category', 'region', 'quarter', 'product'))}),
r AS (SELECT section, name, value, value / t.total AS share, row_number() OVER (PARTITION BY section ORDER BY value DESC, name)::INT AS rank FROM s, t)
SELECT * FROM r WHERE rank <= 10 UNION ALL SELECT 'total', 'revenue', total, 1.0, 1 FROM t UNION ALL SELECT 'total', 'average_order_value', total / n, NULL, 1 FROM t""", "sales")
def _(spark, d, sales):
    return table.executive_report(sales)


@query("t19_dataset_checks", """SELECT n AS "check", CASE WHEN ok THEN 'passed' ELSE 'failed' END AS status FROM (SELECT 'blank_ids' AS n, count(*) FILTER (order_id IS NULL) = 0 AS ok FROM sales UNION ALL SELECT 'revenue', count(*) FILTER (revenue <= 0) = 0 FROM sales
UNION ALL SELECT 'discounts', count(*) FILTER (discount_pct < 0 OR discount_pct > 0.2) = 0 FROM sales UNION ALL SELECT 'minimum', count(*) > 100 FROM sales UNION ALL SELECT 'regions', count(*) FILTER (region NOT IN ('AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST')) = 0 FROM sales)""", "sales")
def _(spark, d, sales):
    rules = [("blank_ids", "order_id IS NULL"), ("revenue", "revenue <= 0"), ("discounts", "discount_pct < 0 OR discount_pct > 0.2"), ("regions", "region NOT IN ('AFRICA','AMERICA','ASIA','EUROPE','MIDDLE EAST')")]
    own = [{"name": n, "table": "data", "where": w, "expect": 0} for n, w in rules] + [{"name": "minimum", "sql": "SELECT count(*) FROM data", "expect_gt": 100}]
    return checks.validate(spark, own, {"data": sales}).select("check", "status")


@query("t20_daily_totals", f"SELECT sale_date AS day, {REPORT} FROM sales GROUP BY sale_date", "sales")
def _(spark, d, sales):
    return table.daily_totals(sales)


@query("t21_enrichment", """SELECT order_id, line_no, month(sale_date)::INT AS sale_month, year(sale_date)::INT AS sale_year, CASE WHEN quantity >= 25 THEN 1 ELSE 0 END AS is_large, date_diff('day', sale_date, DATE '2030-01-01')::INT AS age_days,
CASE WHEN revenue < 1000 THEN 'low' WHEN revenue < 30000 THEN 'mid' ELSE 'high' END AS band FROM sales""", "sales")
def _(spark, d, sales):
    columns = {"sale_month": "month(sale_date)", "sale_year": "year(sale_date)", "is_large": "CASE WHEN quantity >= 25 THEN 1 ELSE 0 END", "age_days": "datediff(DATE '2030-01-01', sale_date)", "band": "CASE WHEN revenue < 1000 THEN 'low' WHEN revenue < 30000 THEN 'mid' ELSE 'high' END"}
    return table.transform(sales, [{"name": k, "sql": v} for k, v in columns.items()]).select("order_id", "line_no", *columns)


_PRICED = " OR ".join(f"category = '{c}' AND unit_price BETWEEN {low} AND {high}" for c, (low, high) in table.PRICES.items())


@query("t22_generate_sales", "SELECT count(*) AS rows, count(*) AS order_ids, true AS in_range, true AS shares_fit, 30 AS products, true AS same_again FROM orders")
def _(spark, d):
    n = source(spark, d, "orders").count()
    made = table.generate_sales(spark, n, 7)
    again = table.generate_sales(spark, n, 7).repartition(3)
    fits = f"({_PRICED}) AND region IS NOT NULL AND quantity BETWEEN 1 AND 10 AND discount_pct BETWEEN 0 AND 0.2 AND abs(revenue - quantity * unit_price * (1 - discount_pct)) < 0.006 AND year(sale_date) = 2024 AND month = month(sale_date)"
    # five standard deviations of a share, so that any number of rows fits
    near = lambda x, share: F.abs(F.count_if(x) / F.count(F.lit(1)) - share) < 5 * F.sqrt(F.lit(share * (1 - share)) / F.count(F.lit(1)))
    shares = near(F.col("discount_pct") == 0, 3 / 7) & near(F.col("category") == "Books", 1 / 6) & near(F.col("region") == "West", 1 / 5)
    whole = F.expr("sum(CAST(xxhash64(*) AS DECIMAL(38,0)))").alias("h")
    return made.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("order_id").alias("order_ids"), F.bool_and(F.expr(fits)).alias("in_range"), shares.alias("shares_fit"), F.count_distinct("category", "product").cast("int").alias("products"), whole).join(again.agg(whole), "h", "left").select("rows", "order_ids", "in_range", "shares_fit", "products", F.col("h").isNotNull().alias("same_again"))


@query("t23_derived_report", "SELECT category AS product_line, orders, total_revenue / orders AS revenue_per_order FROM (SELECT category, count(*) AS orders, CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS total_revenue FROM sales GROUP BY category) WHERE orders > 10", "sales")
def _(spark, d, sales):
    table.materialize(table.revenue_by_category(sales), "category_summary")
    return spark.sql("SELECT category AS product_line, orders, total_revenue / orders AS revenue_per_order FROM category_summary WHERE orders > 10 ORDER BY revenue_per_order DESC")


# --- lineage and catalog -----------------------------------------------------------------------


@query("l1_sql_lineage", "SELECT query_id, 'writes_to' AS direction, 'duckdb://local/' || regexp_extract(sql_text, 'INTO (\\w+)', 1) AS asset_uri FROM sql_log UNION ALL SELECT query_id, 'reads_from', 'duckdb://local/' || unnest(list_distinct(regexp_extract_all(regexp_replace(sql_text, '--.*', ''), '(?:FROM|JOIN) (\\w+)', 1))) FROM sql_log", "sql_log")
def _(spark, d, log):
    return lineage.sql_lineage(log, "sql_text", "query_id")


@query("l2_declared_lineage", "WITH t AS (SELECT DISTINCT pipeline_name, task_name, direction, asset_uri FROM lineage) SELECT pipeline_name, task_name, direction, asset_uri FROM t", "lineage")
def _(spark, d, records):
    names = lambda x: F.collect_set(F.when(F.col("direction") == x, F.col("asset_uri"))).alias(x)
    return lineage.declared_lineage(records.groupBy("pipeline_name", "task_name").agg(names("reads_from"), names("writes_to")))


@query("l3_lineage_edges", "SELECT pipeline_name, task_name, direction, asset_uri, max(recorded_at) AS last_seen FROM lineage GROUP BY ALL", "lineage")
def _(spark, d, records):
    return lineage.lineage_edges(records)


@query("l4_lineage_nodes", "SELECT DISTINCT asset_uri AS id, 'asset' AS type, asset_uri AS label FROM lineage UNION SELECT DISTINCT pipeline_name || '/' || task_name, 'task', task_name FROM lineage", "lineage")
def _(spark, d, records):
    return lineage.lineage_graph(records)[0]


@query("l4_lineage_graph", "SELECT DISTINCT CASE direction WHEN 'reads_from' THEN asset_uri ELSE pipeline_name || '/' || task_name END AS source, CASE direction WHEN 'reads_from' THEN pipeline_name || '/' || task_name ELSE asset_uri END AS target, direction FROM lineage", "lineage")
def _(spark, d, records):
    return lineage.lineage_graph(records)[1]


@query("l5_asset_lineage", "SELECT DISTINCT asset_uri, CASE direction WHEN 'writes_to' THEN 'upstream' ELSE 'downstream' END AS role, pipeline_name, task_name FROM lineage", "lineage")
def _(spark, d, records):
    return lineage.asset_lineage(records)


@query("l5_one_asset", "SELECT DISTINCT asset_uri, CASE direction WHEN 'writes_to' THEN 'upstream' ELSE 'downstream' END AS role, pipeline_name, task_name FROM lineage WHERE asset_uri = 's3://wh/t1'", "lineage")
def _(spark, d, records):
    return lineage.asset_lineage(records, "s3://wh/t1")


@query("l6_search_lineage", "SELECT run_id, pipeline_name, task_name, direction, asset_uri, recorded_at FROM lineage l WHERE (pipeline_name, task_name) IN (SELECT (pipeline_name, task_name) FROM lineage WHERE contains(lower(pipeline_name), 'kafka://wh/t13') OR contains(lower(task_name), 'kafka://wh/t13') OR contains(lower(asset_uri), 'kafka://wh/t13'))", "lineage")
def _(spark, d, records):
    return lineage.search_lineage(records, "KAFKA://wh/t13").select("run_id", "pipeline_name", "task_name", "direction", "asset_uri", "recorded_at")


_TYPE = "CASE WHEN NOT contains(asset_uri, '://') THEN 'Unknown' ELSE CASE split_part(asset_uri, '://', 1) WHEN 'postgres' THEN 'PostgreSQL' WHEN 's3' THEN 'S3' WHEN 'duckdb' THEN 'DuckDB' WHEN 'kafka' THEN 'Kafka' END END"
_ASSETS = f"SELECT asset_uri, count(DISTINCT pipeline_name) AS pipeline_count, count(*) FILTER (direction = 'reads_from') AS read_count, count(*) FILTER (direction = 'writes_to') AS write_count, max(recorded_at) AS last_seen, {_TYPE} AS asset_type FROM lineage {{}} GROUP BY asset_uri"


@query("c1_catalog_assets", _ASSETS.format("") + " ORDER BY pipeline_count DESC, last_seen DESC, asset_uri LIMIT 100", "lineage")
def _(spark, d, records):
    return lineage.catalog_assets(records)


@query("c1_catalog_search", _ASSETS.format("WHERE asset_uri ILIKE '%WH/T1%'") + " ORDER BY pipeline_count DESC, last_seen DESC, asset_uri LIMIT 100", "lineage")
def _(spark, d, records):
    return lineage.catalog_assets(records, "WH/T1")


@query("c2_asset_type", f"SELECT DISTINCT asset_uri, {_TYPE} AS asset_type FROM lineage", "lineage")
def _(spark, d, records):
    return records.select("asset_uri", lineage.asset_type("asset_uri").alias("asset_type")).distinct()


@query("c3_asset_detail", "SELECT asset_uri, pipeline_name, task_name, direction, max(recorded_at) AS last_seen, (SELECT count(DISTINCT pipeline_name) FROM lineage WHERE asset_uri = 's3://wh/t1') AS pipeline_count FROM lineage WHERE asset_uri = 's3://wh/t1' GROUP BY ALL", "lineage")
def _(spark, d, records):
    return lineage.asset_detail(records, "s3://wh/t1")


@query("c4_pipeline_catalog", "SELECT pipeline_name, count(DISTINCT asset_uri) AS asset_count, count(DISTINCT asset_uri) FILTER (direction = 'reads_from') AS inputs, count(DISTINCT asset_uri) FILTER (direction = 'writes_to') AS outputs, max(recorded_at) AS last_run FROM lineage GROUP BY pipeline_name", "lineage")
def _(spark, d, records):
    return lineage.pipeline_catalog(records)


@query("c5_catalog_totals", "SELECT count(*) AS assets, sum(n)::BIGINT AS pipeline_links FROM (SELECT asset_uri, count(DISTINCT pipeline_name) AS n FROM lineage GROUP BY 1)", "lineage")
def _(spark, d, records):
    return lineage.catalog_totals(records)


# --- runs, quality, service levels, audit ------------------------------------------------------

_LATEST = "SELECT run_id, pipeline_name, status, message, details, duration_seconds, updated_at FROM runs QUALIFY row_number() OVER (PARTITION BY {} ORDER BY updated_at DESC NULLS LAST, run_id DESC NULLS LAST, pipeline_name DESC NULLS LAST, status DESC NULLS LAST, message DESC NULLS LAST, details DESC NULLS LAST, duration_seconds DESC NULLS LAST) = 1"


@query("r1_latest_by_pipeline", _LATEST.format("pipeline_name"), "runs")
def _(spark, d, events):
    return runs.latest_by(events, ["pipeline_name"], "updated_at", "run_id")


@query("r2_latest_by_run", _LATEST.format("run_id"), "runs")
def _(spark, d, events):
    return runs.latest_by(events, ["run_id"], "updated_at")


_HISTORY = "SELECT r.* FROM runs r JOIN (SELECT * FROM (SELECT pipeline_name, run_id, max(updated_at) AS m FROM runs GROUP BY pipeline_name, run_id) QUALIFY row_number() OVER (PARTITION BY pipeline_name ORDER BY m DESC, run_id) <= 5) t ON r.pipeline_name = t.pipeline_name AND r.run_id = t.run_id AND r.updated_at = t.m"


@query("r3_run_history", f"{_HISTORY} WHERE r.pipeline_name = 'pipe_3'", "runs")
def _(spark, d, events):
    return runs.run_history(events, "pipe_3")


@query("r3_run_history_all", _HISTORY, "runs")
def _(spark, d, events):
    return runs.run_history(events)


@query("r4_pipeline_names", "SELECT DISTINCT pipeline_name FROM runs", "runs")
def _(spark, d, events):
    return runs.pipeline_names(events)


@query("r5_run_counts", "SELECT pipeline_name, status, count(*) AS count FROM runs GROUP BY ALL", "runs")
def _(spark, d, events):
    return runs.run_counts(events)


_QUALITY = "SELECT * FROM quality WHERE pipeline_name = 'pipe_3' ORDER BY checked_at DESC, run_id, task_name, check_name LIMIT 50"


@query("r6_quality_history", _QUALITY, "quality")
def _(spark, d, results):
    return runs.quality_history(results, "pipe_3")[0]


@query("r6_quality_totals", f"SELECT count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM ({_QUALITY})", "quality")
def _(spark, d, results):
    return runs.quality_history(results, "pipe_3")[1]


@query("r7_quality_counts", "SELECT pipeline_name, task_name, passed, count(*) AS count FROM quality GROUP BY ALL", "quality")
def _(spark, d, results):
    return runs.quality_counts(results)


_BROKEN = "SELECT r.*, max_duration_minutes * 60 AS limit_seconds FROM runs r JOIN slas s ON r.pipeline_name = s.pipeline_name WHERE duration_seconds > max_duration_minutes * 60"


@query("r8_sla_violations", _BROKEN, "runs", "slas")
def _(spark, d, events, slas):
    return runs.sla_violations(events, slas)


@query("r9_recent_violations", f"SELECT * FROM ({_BROKEN}) WHERE pipeline_name = 'pipe_4' ORDER BY updated_at DESC, run_id LIMIT 20", "runs", "slas")
def _(spark, d, events, slas):
    return runs.recent_rows(runs.sla_violations(events, slas), {"pipeline_name": "pipe_4"}, "updated_at", 20, "run_id")


@query("r10_sla_counts", f"SELECT pipeline_name, count(*) AS count FROM ({_BROKEN}) GROUP BY pipeline_name", "runs", "slas")
def _(spark, d, events, slas):
    return runs.sla_counts(runs.sla_violations(events, slas))


_SUMMARY = """SELECT p.pipeline_name, coalesce(l.status, 'never_run') AS last_status, coalesce(l.message, 'No runs yet') AS last_message, l.updated_at AS last_updated_at, least(coalesce(n, 0), 5) AS run_count, p.schedule IS NOT NULL AS is_scheduled, p.schedule, coalesce(l.status, 'idle') AS health
FROM pipelines p LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY pipeline_name ORDER BY updated_at DESC, run_id DESC) = 1) l USING (pipeline_name) LEFT JOIN (SELECT pipeline_name, count(DISTINCT run_id) AS n FROM runs GROUP BY 1) c USING (pipeline_name)"""


def _summary(pipelines, events):
    return runs.pipeline_summary(pipelines.select("pipeline_name"), events, pipelines.filter("schedule IS NOT NULL"))


@query("r11_pipeline_summary", _SUMMARY, "pipelines", "runs")
def _(spark, d, pipelines, events):
    return _summary(pipelines, events)


@query("r12_workspace_stats", f"SELECT count(*) AS total_pipelines, count(*) FILTER (is_scheduled) AS scheduled_pipelines, count(*) FILTER (health IN ('started','running')) AS active_runs, count(*) FILTER (last_status = 'completed') AS successful_pipelines, count(*) FILTER (last_status = 'failed') AS failed_pipelines FROM ({_SUMMARY})", "pipelines", "runs")
def _(spark, d, pipelines, events):
    return runs.workspace_stats(_summary(pipelines, events))


@query("r13_recent_runs", f"{_HISTORY} ORDER BY r.updated_at DESC, r.pipeline_name, r.run_id LIMIT 12", "runs")
def _(spark, d, events):
    return runs.recent_runs(events)


@query("r14_metrics_text", f"""SELECT 'dp_pipeline_runs_total{{pipeline="' || pipeline_name || '",status="' || status || '"}} ' || count(*) AS value FROM runs GROUP BY pipeline_name, status
UNION ALL SELECT 'dp_quality_check_results_total{{pipeline="' || pipeline_name || '",task="' || task_name || '",result="' || CASE WHEN passed THEN 'passed' ELSE 'failed' END || '"}} ' || count(*) FROM quality GROUP BY pipeline_name, task_name, passed
UNION ALL SELECT 'dp_sla_violations_total{{pipeline="' || pipeline_name || '"}} ' || count(*) FROM ({_BROKEN}) GROUP BY pipeline_name""", "runs", "quality", "slas")
def _(spark, d, events, results, slas):
    return runs.metrics_text(events, results, runs.sla_violations(events, slas)).filter("part = 1").select("value")


@query("r15_queue_listing", "SELECT * FROM queue WHERE status = 'queued' ORDER BY queued_at DESC, run_id LIMIT 50", "queue")
def _(spark, d, queue):
    return runs.recent_rows(queue, {"status": "queued"}, "queued_at", 50, "run_id")


@query("r16_recover_orphans", "SELECT run_id, CASE WHEN status IN ('queued','running') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued','running') THEN TIMESTAMP '2024-01-01' ELSE completed_at END AS completed_at, CASE WHEN status IN ('queued','running') THEN 'Interrupted by a restart' END AS error, status IN ('queued','running') AS recovered FROM queue", "queue")
def _(spark, d, queue):
    return runs.recover_orphans(queue, F.expr("TIMESTAMP_NTZ '2024-01-01'")).select("run_id", "status", "completed_at", "error", "recovered")


@query("r17_fold_run_state", """WITH e AS (SELECT *, CASE WHEN status = 'failed' THEN details END AS error, status NOT IN ('queued','running') AS ended FROM runs),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC NULLS LAST, status DESC NULLS LAST, error DESC NULLS LAST, pipeline_name DESC NULLS LAST) AS nth, row_number() OVER (PARTITION BY run_id, ended ORDER BY updated_at DESC NULLS LAST, status DESC NULLS LAST, error DESC NULLS LAST) AS nth_end FROM e)
SELECT run_id, max(pipeline_name) FILTER (nth = 1) AS pipeline_name, max(status) FILTER (nth = 1) AS status, min(updated_at) FILTER (status = 'queued') AS queued_at, max(updated_at) FILTER (status = 'running') AS started_at,
max(updated_at) FILTER (ended) AS completed_at, max(error) FILTER (ended AND nth_end = 1) AS error FROM n GROUP BY run_id""", "runs")
def _(spark, d, events):
    return runs.fold_run_state(events.withColumn("error", F.when(F.col("status") == "failed", F.col("details"))))


@query("r18_audit_events", "SELECT event_id, event_type, actor, resource, details, occurred_at, CAST(json_extract(details, '$.k') AS BIGINT) AS k FROM audit WHERE event_type = 'purchase' AND resource = 'pipe_7' ORDER BY occurred_at DESC, event_id LIMIT 100", "audit")
def _(spark, d, log):
    return runs.audit_events(log, resource="pipe_7", event_type="purchase").withColumn("k", F.try_variant_get("details_json", "$.k", "long")).drop("details_json")


@query("r19_recent_pushes", "SELECT event_id, actor, occurred_at AS pushed_at FROM audit WHERE actor = 'user_7' ORDER BY occurred_at DESC, event_id LIMIT 30", "audit")
def _(spark, d, log):
    pushes = log.select("event_id", "actor", F.col("occurred_at").alias("pushed_at"))
    return runs.recent_rows(pushes, {"actor": "user_7"}, "pushed_at", 30, "event_id")


@query("r20_error_summary", "SELECT run_id, string_agg(status || ': ' || details, '; ' ORDER BY status || ': ' || details) AS message FROM runs WHERE status = 'failed' GROUP BY run_id", "runs")
def _(spark, d, events):
    return runs.error_summary(events.filter("status = 'failed'").select("run_id", F.col("status").alias("task_name"), F.col("details").alias("error")), ["run_id"])


# --- costs -------------------------------------------------------------------------------------

_COST = "count(*) AS runs, CAST(sum(CAST(duration_seconds AS DECIMAL(24,6))) AS DOUBLE) AS duration_seconds, CAST(sum(CAST(estimated_cost_usd AS DECIMAL(24,6))) AS DOUBLE) AS cost"


@query("k1_run_cost", "SELECT run_id, task_count, CAST(round(task_count * duration_seconds * 0.0001::DOUBLE, 6) * 1e6 AS BIGINT) AS micro_units FROM costs", "costs")
def _(spark, d, costs):
    return runs.run_cost(costs).select("run_id", "task_count", F.round(F.col("estimated_cost_usd") * 1e6).cast("long").alias("micro_units"))


@query("k2_cost_by_pipeline", f"SELECT pipeline_name, team, {_COST}, max(recorded_at) AS last_run, 'compute_units' AS unit FROM costs GROUP BY pipeline_name, team ORDER BY cost DESC, pipeline_name, team NULLS LAST LIMIT 100", "costs")
def _(spark, d, costs):
    return runs.cost_by_pipeline(costs)


@query("k3_cost_by_team", f"SELECT coalesce(team, 'unassigned') AS team, count(DISTINCT pipeline_name) AS pipelines, {_COST} FROM costs GROUP BY costs.team", "costs")
def _(spark, d, costs):
    return runs.cost_by_team(costs)


_LAST_COSTS = "SELECT * FROM costs WHERE pipeline_name = 'pipe_5' ORDER BY recorded_at DESC, run_id LIMIT 20"


@query("k4_cost_history", _LAST_COSTS, "costs")
def _(spark, d, costs):
    return runs.cost_history(costs, "pipe_5")[0]


@query("k4_cost_history_total", f"SELECT CAST(sum(CAST(estimated_cost_usd AS DECIMAL(24,6))) AS DOUBLE) AS total_cost FROM ({_LAST_COSTS})", "costs")
def _(spark, d, costs):
    return runs.cost_history(costs, "pipe_5")[1]


@query("k5_cost_totals", f"SELECT {_COST} FROM costs", "costs")
def _(spark, d, costs):
    return runs.cost_totals(costs)


@query("k6_run_share", "SELECT pipeline_name, runs, 100 * runs / max(runs) OVER () AS percent FROM (SELECT pipeline_name, count(*) AS runs FROM costs GROUP BY 1 ORDER BY runs DESC, pipeline_name LIMIT 10)", "costs")
def _(spark, d, costs):
    return runs.run_share(costs)


# --- metrics -----------------------------------------------------------------------------------

METRICS = [
    {"metric_name": "orders", "sql": "SELECT count(*) FROM data"},
    {"metric_name": "regions", "sql": "SELECT count(DISTINCT region) FROM data"},
    {"metric_name": "nothing", "sql": "SELECT max(line_no) FROM data WHERE line_no < 0"},
    {"metric_name": "no_row", "sql": "SELECT line_no FROM data WHERE line_no < 0"},
    {"metric_name": "broken", "sql": "SELECT missing_column FROM data"},
]


def _definitions(spark, d, text) -> str:
    """A folder with a definition file of each supplier."""
    folder = scratch_dir(spark, "definitions")
    files.write_text_files(source(spark, d, "supplier").select(F.expr(_SUPPLIER_FILE), F.concat(F.expr(text), F.lit("\n")).alias("content")), folder)
    return folder


_METRIC = r"""concat('metric_name: "  ', s_name, ' "\nowner: nation ', s_nationkey, CASE WHEN s_acctbal >= 0 THEN concat('\nsql: |\n  SELECT count(*) FROM t', s_nationkey) ELSE '' END)"""


@query("m1_load_metrics", "SELECT s_name AS metric_name, CASE WHEN s_acctbal >= 0 THEN 'SELECT count(*) FROM t' || s_nationkey ELSE '' END AS sql, '' AS description, 'nation ' || s_nationkey AS owner, CASE WHEN s_acctbal < 0 THEN 'missing: sql' END AS error FROM supplier")
def _(spark, d):
    return checks.load_metrics(spark, _definitions(spark, d, _METRIC)).drop("path")


@query("m2_list_metrics", "SELECT s_name AS metric_name, '' AS description, 'nation ' || s_nationkey AS owner FROM supplier WHERE s_acctbal >= 0")
def _(spark, d):
    return checks.list_metrics(checks.load_metrics(spark, _definitions(spark, d, _METRIC)))


@query("m3_compute_metrics", "SELECT 'orders' AS metric_name, count(*)::DOUBLE AS value, false AS failed FROM sales UNION ALL SELECT 'regions', count(DISTINCT region), false FROM sales UNION ALL SELECT 'nothing', NULL, false UNION ALL SELECT 'no_row', NULL, false UNION ALL SELECT 'broken', NULL, true", "sales")
def _(spark, d, sales):
    return checks.compute_metrics(spark, METRICS, {"data": sales}).select("metric_name", "value", F.col("error").isNotNull().alias("failed"))


@query("m4_metric_history", "SELECT check_name AS metric_name, actual_value AS value, checked_at AS computed_at, run_id FROM quality WHERE check_name = 'click' ORDER BY checked_at DESC, run_id LIMIT 50", "quality")
def _(spark, d, results):
    history = results.select(F.col("check_name").alias("metric_name"), F.col("actual_value").alias("value"), F.col("checked_at").alias("computed_at"), "run_id")
    return runs.recent_rows(history, {"metric_name": "click"}, "computed_at", 50, "run_id")


# --- versions ----------------------------------------------------------------------------------


@query("v1_dedupe_versions", "SELECT version_id, pipeline_name, saved_seq, sha256(content) AS version_hash FROM versions QUALIFY row_number() OVER (PARTITION BY pipeline_name, sha256(content) ORDER BY saved_seq, version_id) = 1", "versions")
def _(spark, d, rows):
    return versions.dedupe_versions(rows).drop("content")


@query("v1_new_versions", "SELECT version_id, pipeline_name, sha256(content) AS version_hash FROM versions v WHERE version_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM versions o WHERE o.version_id % 2 = 0 AND o.pipeline_name = v.pipeline_name AND o.content = v.content) QUALIFY row_number() OVER (PARTITION BY pipeline_name, content ORDER BY version_id) = 1", "versions")
def _(spark, d, rows):
    return versions.new_versions(rows.filter("version_id % 2 = 0"), rows.filter("version_id % 2 = 1")).select("version_id", "pipeline_name", "version_hash")


@query("v2_list_versions", "SELECT version_id, pipeline_name, saved_seq FROM versions WHERE pipeline_name = 'en' ORDER BY saved_seq DESC, version_id DESC LIMIT 20", "versions")
def _(spark, d, rows):
    return versions.list_versions(rows, "en")


@query("v3_version_content", "SELECT version_id, content FROM versions WHERE pipeline_name = 'en' AND version_id = 7", "versions")
def _(spark, d, rows):
    return versions.version_content(rows, "en", 7)


@query("v4_version_diff", """WITH i AS (SELECT pipeline_name, version_id, lag(version_id) OVER w AS previous FROM versions WINDOW w AS (PARTITION BY pipeline_name ORDER BY saved_seq, version_id)),
c AS (SELECT version_id, line, count(*) AS n FROM (SELECT version_id, unnest(string_split(content, chr(10))) AS line FROM versions) GROUP BY ALL),
n AS (SELECT i.pipeline_name, i.version_id, i.previous, c.line, c.n AS a, 0 AS b FROM i JOIN c ON c.version_id = i.version_id WHERE previous IS NOT NULL UNION ALL SELECT i.pipeline_name, i.version_id, i.previous, c.line, 0, c.n FROM i JOIN c ON c.version_id = i.previous)
SELECT pipeline_name, version_id, previous, sum(greatest(a - b, 0))::BIGINT AS added, sum(greatest(b - a, 0))::BIGINT AS removed FROM (SELECT pipeline_name, version_id, previous, line, sum(a) AS a, sum(b) AS b FROM n GROUP BY ALL) GROUP BY ALL""", "versions")
def _(spark, d, rows):
    return versions.version_diff(rows)


# --- definitions -------------------------------------------------------------------------------


def _tasks(tasks: DataFrame) -> DataFrame:
    """A task table: every task needs the one before it, by its id if that is even, and one in ten something unknown."""
    before = F.concat(F.when(F.col("n") % 2 == 0, "task_").otherwise("id_"), (F.col("n") - 1).cast("string"))
    needs = F.array_compact(F.array(F.when(F.col("n") > 0, before), F.when(F.col("size") % 10 == 0, F.lit("nowhere")), F.when(F.col("size") % 17 == 0, F.coalesce("id", "name"))))
    return tasks.select("pipeline", "name", "id", "plugin", F.array("tag").alias("tags"), needs.alias("depends_on"))


_NEEDS = """t AS (SELECT pipeline, name, id, list_filter([CASE WHEN n > 0 THEN (CASE WHEN n % 2 = 0 THEN 'task_' ELSE 'id_' END) || (n - 1) END, CASE WHEN size % 10 = 0 THEN 'nowhere' END, CASE WHEN size % 17 = 0 THEN coalesce(id, name) END], lambda x: x IS NOT NULL) AS needs FROM tasks),
x AS (SELECT pipeline, name, coalesce(id, name) AS own, unnest(needs) AS alias FROM t), a AS (SELECT pipeline, name AS alias, name FROM t UNION SELECT pipeline, id, name FROM t WHERE id IS NOT NULL)"""


_PIPELINE = r"""concat('pipeline_name: ', s_name, '\nteam: team_', s_nationkey, '\ntags: [daily, n', s_nationkey, ']\nschedule: {hour: ', s_nationkey, '}\ntasks:', CASE WHEN s_acctbal >= 0 THEN '\n- {name: load, plugin: csv}\n- {name: check, depends_on: [load]}' WHEN s_nationkey < 12 THEN ' []' ELSE ' [' END)"""


@query("p1_pipeline_inventory", """WITH s AS (SELECT *, s_acctbal >= 0 AS good FROM supplier) SELECT s_suppkey::INT AS s_suppkey, CASE WHEN good THEN s_name END AS pipeline_name, CASE WHEN good THEN 'team_' || s_nationkey END AS team, CASE WHEN good THEN 'daily,n' || s_nationkey END AS tags,
    CASE WHEN good THEN s_nationkey::VARCHAR END AS hour, CASE WHEN good THEN 'load,check' END AS tasks, CASE WHEN good THEN 'load' END AS depends_on, CASE WHEN NOT good THEN CASE WHEN s_nationkey < 12 THEN 'ValueError' ELSE 'ParserError' END END AS error_type, NOT good AS failed FROM s""")
def _(spark, d):
    found = definitions.pipeline_inventory(spark, _definitions(spark, d, _PIPELINE))
    joined = lambda c, a: F.array_join(c, ",").alias(a)
    return found.select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("int").alias("s_suppkey"), "pipeline_name", "team", joined("tags", "tags"), F.col("schedule")["hour"].alias("hour"), joined("tasks.name", "tasks"), joined(F.flatten("tasks.depends_on"), "depends_on"), "error_type", F.col("error").isNotNull().alias("failed"))


@query("p2_template_metadata", "SELECT pipeline, count(*) AS task_count, array_to_string(list_sort(list_distinct(list(plugin))), ',') AS plugins, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags FROM tasks GROUP BY pipeline", "tasks")
def _(spark, d, tasks):
    return definitions.template_metadata(_tasks(tasks)).withColumns({"plugins": F.array_join("plugins", ","), "tags": F.array_join("tags", ",")})


@query("p3_definition_errors", f"WITH {_NEEDS} SELECT x.pipeline, 'unknown_dependency' AS error, x.name || ' -> ' || x.alias AS detail FROM x ANTI JOIN a ON x.pipeline = a.pipeline AND x.alias = a.alias UNION ALL SELECT pipeline, 'self_dependency', name FROM x WHERE own = alias UNION ALL SELECT pipeline, 'duplicate_name', name FROM t GROUP BY pipeline, name HAVING count(*) > 1", "tasks")
def _(spark, d, tasks):
    return definitions.definition_errors(_tasks(tasks))


@query("p4_topo_levels", "WITH RECURSIVE up AS (SELECT DISTINCT pipeline, depends_on AS task, 0 AS level FROM edges UNION SELECT DISTINCT pipeline, task, 0 FROM edges UNION SELECT e.pipeline, e.task, up.level + 1 FROM edges e JOIN up ON e.pipeline = up.pipeline AND e.depends_on = up.task) SELECT pipeline, task, max(level)::BIGINT AS level, false AS cyclic FROM up GROUP BY pipeline, task", "edges")
def _(spark, d, edges):
    return definitions.topo_levels(edges)


ORACLE_SQL["p4_topo_levels"] = ORACLE_SQL["p4_topo_levels"].replace("WITH edges", "WITH RECURSIVE edges").replace(", RECURSIVE up", ", up")


@query("p5_task_edges", f"WITH {_NEEDS} SELECT DISTINCT x.pipeline, a.name AS source, x.name AS target FROM x JOIN a ON x.pipeline = a.pipeline AND x.alias = a.alias", "tasks")
def _(spark, d, tasks):
    return definitions.task_edges(_tasks(tasks))


# --- user functions ----------------------------------------------------------------------------


@query("p6_operators_for", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'profile' WHEN 1 THEN 'query' WHEN 2 THEN 'export' ELSE 'none' END AS operation, CASE p_size % 4 WHEN 0 THEN 'tidemill.operators.table' WHEN 1 THEN 'tidemill.operators.table,tidemill.sources.external' WHEN 2 THEN 'tidemill.sources.external,tidemill.sources.files' ELSE '' END AS modules FROM part")
def _(spark, d):
    asked = source(spark, d, "part").select("p_partkey", F.expr("CASE p_size % 4 WHEN 0 THEN 'profile' WHEN 1 THEN 'query' WHEN 2 THEN 'export' ELSE 'none' END").alias("operation"))
    return definitions.operators_for(spark, asked).withColumn("modules", F.array_join("modules", ","))


@query("u1_python_step", "SELECT l_orderkey, l_linenumber, l_quantity * 3 AS scaled FROM lineitem")
def _(spark, d):
    rows = source(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")

    def scale(pdf, by):
        return pdf.assign(scaled=pdf["l_quantity"] * by)[["l_orderkey", "l_linenumber", "scaled"]]

    return registry.python_step(rows, scale, {"by": 3}, "l_orderkey long, l_linenumber int, scaled double")


@query("u2_register_udf", "SELECT p_partkey, length(p_name) AS name_length FROM part")
def _(spark, d):
    registry.register_udf(spark, "name_length", lambda s: s.str.len(), "long")
    return table.run_query(spark, "SELECT p_partkey, name_length(p_name) AS name_length FROM data", {"data": source(spark, d, "part")})


@query("u3_run_operator", "SELECT s_nationkey, count(*) AS n, count(*) FILTER (s_acctbal >= 0) AS held FROM supplier GROUP BY s_nationkey")
def _(spark, d):
    @registry.operator("count_by")
    def count_by(df, key, where="true"):
        return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(where)).alias("held"))

    return registry.run_operator("count_by", source(spark, d, "supplier"), {"key": "s_nationkey", "where": "s_acctbal >= 0"})


# --- streams -----------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The view ``name`` over the events table read as a stream."""
    streams.table_stream(spark, f"{d}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(spark_text(name))


@query("st1_file_arrivals", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    out = scratch_dir(spark, "arrivals")
    source_path = f"{d}/events.parquet"
    streams.file_arrivals(spark, source_path, spark.read.parquet(source_path).schema, lambda rows, k: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(out), scratch_dir(spark, "checkpoint"), every=None).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("st2_completion_fires", "SELECT r.run_id, r.pipeline_name, r.updated_at, 'pipe_' || (n_nationkey + 1) AS downstream FROM runs r JOIN nation ON r.pipeline_name = 'pipe_' || n_nationkey WHERE status = 'completed'", "runs")
def _(spark, d, events):
    registered = stored(source(spark, d, "nation").select(F.concat(F.lit("pipe_"), F.col("n_nationkey").cast("string")).alias("pipeline_name"), F.concat(F.lit("pipe_"), (F.col("n_nationkey") + 1).cast("string")).alias("downstream")))
    return streams.drain(streams.completion_fires(_stream(spark, d, "runs"), registered).select("run_id", "pipeline_name", "updated_at", "downstream"))


@query("st2_completion_once", "SELECT DISTINCT r.run_id, r.pipeline_name, 'pipe_' || (n_nationkey + 1) AS downstream FROM runs r JOIN nation ON r.pipeline_name = 'pipe_' || n_nationkey WHERE status = 'completed'", "runs")
def _(spark, d, events):
    """Every completion arrives twice, in two batches, and each run has several of its own."""
    sent, name = scratch_dir(spark, "sent"), F.concat(F.lit("pipe_"), F.col("n_nationkey").cast("string"))
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(sent)
    registered = stored(source(spark, d, "nation").select(name.alias("pipeline_name"), F.concat(F.lit("pipe_"), (F.col("n_nationkey") + 1).cast("string")).alias("downstream")))
    stream = streams.table_stream(spark, sent, schema=events.schema, per_trigger=1)
    return streams.drain(streams.completion_fires(stream, registered, "1000 days").select("run_id", "pipeline_name", "downstream"))


@query("st1_file_changes", "SELECT s_suppkey::INT AS s_suppkey, 1 + (s_acctbal < 0)::INT AS fired, length(s_name) + 1 + CASE WHEN s_acctbal < 0 THEN 5 ELSE 0 END AS size FROM supplier")
def _(spark, d):
    folder, seen, checkpoint = (scratch_dir(spark, n) for n in ("watched", "seen", "checkpoint"))
    rows = source(spark, d, "supplier")
    for text in (rows, rows.filter("s_acctbal < 0").withColumn("s_name", F.concat("s_name", F.lit(" more")))):
        files.write_text_files(text.select(F.expr(_SUPPLIER_FILE), F.concat("s_name", F.lit("\n")).alias("content")), folder)
        streams.file_changes(spark, folder, "*.txt", existing=True, recursive=True).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(seen).awaitTermination()
    number = F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("int").alias("s_suppkey")
    return spark.read.parquet(seen).groupBy(number).agg(F.count(F.lit(1)).cast("int").alias("fired"), F.max("size").alias("size"))


@query("st3_tail_lines", "SELECT p_name AS line, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY p_name")
def _(spark, d):
    folder = scratch_dir(spark, "lines")
    files.write_text(source(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" \t"), "p_name", F.lit("\t\r"))).otherwise("\t \r").alias("line")), folder)
    return streams.drain(streams.tail_lines(spark, folder)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("st5_run_counts_stream", "SELECT CAST(updated_at AS DATE) AS day, pipeline_name, status, count(*) AS count FROM runs GROUP BY ALL", "runs")
def _(spark, d, events):
    counts = streams.drain(streams.run_counts_stream(_stream(spark, d, "runs")), "complete")
    return counts.select(F.to_date("window_start").alias("day"), "pipeline_name", "status", "count")


@query("st6_sla_stream", f"SELECT run_id, pipeline_name, duration_seconds, limit_seconds FROM ({_BROKEN})", "runs", "slas")
def _(spark, d, events, slas):
    return streams.drain(streams.sla_stream(_stream(spark, d, "runs"), stored(slas)).select("run_id", "pipeline_name", "duration_seconds", "limit_seconds"))


_GATED = [{"name": "rows", "sql": "SELECT count(*) FROM data", "expect_min": 1}, {"name": "no_nulls", "table": "data", "where": "value IS NULL", "expect": 0}, {"name": "small", "sql": "SELECT max(value) FROM data", "expect_max": 1}]
_GATES = "SELECT 'rows' AS check_name, count(*) > 0 AS passed FROM events UNION ALL SELECT 'no_nulls', count(*) FILTER (value IS NULL) = 0 FROM events UNION ALL SELECT 'small', max(value) <= 1 FROM events"


@query("st7_quality_stream", _GATES)
def _(spark, d):
    folder = scratch_dir(spark, "gates")
    streams.quality_stream(streams.table_stream(spark, f"{d}/events.parquet"), _GATED, folder, scratch_dir(spark, "checkpoint")).awaitTermination()
    return files.read_history(spark, folder, "quality_results").groupBy("check_name").agg(F.bool_and("passed").alias("passed"))


@query("st7_replayed", f"SELECT check_name, passed, 1 AS times FROM ({_GATES})")
def _(spark, d):
    """The stream's record that a batch is done is lost, so the batch is sent again; its results are there once."""
    folder, checkpoint = scratch_dir(spark, "gates"), scratch_dir(spark, "checkpoint")
    for _ in range(2):
        streams.quality_stream(streams.table_stream(spark, f"{d}/events.parquet"), _GATED, folder, checkpoint).awaitTermination()
        files.delete(spark, f"{checkpoint}/commits/0")
    return files.read_history(spark, folder, "quality_results").groupBy("check_name").agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).cast("int").alias("times"))


# --- SQL that later steps may use ---------------------------------------------------------------

sql_query("j_filters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority LIKE '%-%' AND o_orderpriority NOT LIKE '3%' AND o_custkey IS NOT NULL", None, "orders")
sql_query("j_joins", "SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'O' GROUP BY c.c_custkey, c.c_name", None, "customer", "orders")
sql_query("j_semi_anti", "SELECT 'with' AS kind, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) UNION ALL SELECT 'without', count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None, "customer", "orders")
sql_query("j_full_join", "SELECT n_name, s_name FROM nation FULL OUTER JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000", None, "nation", "supplier")
sql_query("j_aggregates", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS deals FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10", None, "lineitem")
sql_query("j_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None, "lineitem")
sql_query("j_windows", "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS nth, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders", None, "orders")
sql_query("j_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None, "orders")
sql_query("j_set_ops", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1", None, "supplier", "customer", "nation")
sql_query("j_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", None, "orders", "customer")
sql_query("j_functions", "SELECT p_partkey, upper(trim(p_name)) AS name, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand, CAST(p_size AS DOUBLE) / 4 AS quarter, abs(p_size - 25) AS off, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind FROM part", None, "part")
sql_query("j_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate + INTERVAL '1' DAY AS DATE) AS next_day, datediff(DATE '2030-01-01', CAST(o_orderdate AS DATE)) AS age FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate + INTERVAL 1 DAY AS DATE) AS next_day, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') AS INT) AS age FROM orders", "orders")
sql_query("j_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", "events")
sql_query("j_arrays", "SELECT pos, count(*) AS n, count(DISTINCT word) AS words FROM (SELECT posexplode(split(p_name, ' ')) AS (pos, word) FROM part) GROUP BY pos", "SELECT CAST(pos - 1 AS INT) AS pos, count(*) AS n, count(DISTINCT word) AS words FROM (SELECT unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part) GROUP BY pos", "part")
sql_query("j_right_join", "SELECT s_name, n_name, r_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 9000 RIGHT JOIN region ON n_regionkey = r_regionkey", None, "supplier", "nation", "region")
sql_query("j_cross_join", "SELECT n_name, r_name FROM nation CROSS JOIN region WHERE n_regionkey <> r_regionkey", None, "nation", "region")
sql_query("j_cube", "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag) AS no_flag, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) AS TINYINT) AS no_flag, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
sql_query("j_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None, "orders")
sql_query("j_maps", "SELECT p_partkey, element_at(m, 'size') AS size, element_at(m, 'brand') AS brand, array_join(array_sort(map_keys(m)), ',') AS keys, CAST(cardinality(m) AS BIGINT) AS n FROM (SELECT p_partkey, map('size', CAST(p_size AS STRING), 'brand', p_brand) AS m FROM part)", "SELECT p_partkey, m['size'] AS size, m['brand'] AS brand, array_to_string(list_sort(map_keys(m)), ',') AS keys, CAST(cardinality(m) AS BIGINT) AS n FROM (SELECT p_partkey, MAP {'size': CAST(p_size AS VARCHAR), 'brand': p_brand} AS m FROM part)", "part")
