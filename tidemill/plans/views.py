"""Views over the test tables, in one SQL text for Spark and for DuckDB."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: ``DIV(a,b)`` stands for integer division.
VIEWS = {
    "sales": """SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, p.p_name AS product, p.p_type AS category, r.r_name AS region, l.l_quantity AS quantity, p.p_retailprice AS unit_price,
        l.l_discount AS discount_pct, l.l_extendedprice * (1 - l.l_discount) AS revenue, CAST(l.l_shipdate AS DATE) AS sale_date, CAST(month(l.l_shipdate) AS INT) AS month, CAST(quarter(l.l_shipdate) AS INT) AS quarter
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "demo_orders": """SELECT o.o_orderkey AS order_id, o.o_custkey AS customer, lower(r.r_name) AS region, o.o_totalprice AS amount, o.o_orderstatus AS status
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "runs": """SELECT concat('run_', CAST(DIV(event_id,3) AS STRING)) AS run_id, concat('pipe_', CAST(DIV(event_id,3) % 20 AS STRING)) AS pipeline_name,
        CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
        concat('event ', CAST(event_id AS STRING)) AS message, props AS details, value AS duration_seconds, ts AS updated_at FROM events""",
    "lineage": """SELECT concat('run_', CAST(l_orderkey AS STRING)) AS run_id, concat('pipe_', CAST(l_suppkey % 50 AS STRING)) AS pipeline_name, concat('task_', CAST(l_linenumber AS STRING)) AS task_name,
        CASE WHEN l_returnflag = 'A' THEN 'writes_to' ELSE 'reads_from' END AS direction,
        concat(CASE l_partkey % 5 WHEN 0 THEN 'postgres://' WHEN 1 THEN 's3://' WHEN 2 THEN 'duckdb://' WHEN 3 THEN 'kafka://' ELSE '' END, 'wh/t', CAST(l_partkey % 200 AS STRING)) AS asset_uri, l_shipdate AS recorded_at FROM lineitem""",
    "quality": """SELECT concat('run_', CAST(DIV(event_id,3) AS STRING)) AS run_id, concat('pipe_', CAST(DIV(event_id,3) % 20 AS STRING)) AS pipeline_name, concat('task_', CAST(user_id % 6 AS STRING)) AS task_name,
        event_type AS check_name, value < 100 AS passed, value AS actual_value, ts AS checked_at FROM events""",
    "costs": """SELECT concat('run_', CAST(o_orderkey AS STRING)) AS run_id, concat('pipe_', CAST(o_custkey % 100 AS STRING)) AS pipeline_name, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('team_', CAST(o_custkey % 7 AS STRING)) END AS team,
        CAST(1 + o_orderkey % 8 AS INT) AS task_count, o_totalprice / 1000 AS duration_seconds, CAST(CAST((1 + o_orderkey % 8) * CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS DOUBLE) AS estimated_cost_usd, o_orderdate AS recorded_at FROM orders""",
    "slas": """SELECT concat('pipe_', CAST(n_nationkey AS STRING)) AS pipeline_name, CAST(1 + n_nationkey % 4 AS DOUBLE) AS max_duration_minutes FROM nation""",
    "versions": """SELECT doc_id AS version_id, lang AS pipeline_name, text AS content, doc_id AS saved_seq FROM documents""",
    "audit": """SELECT event_id, event_type, concat('user_', CAST(user_id AS STRING)) AS actor, concat('pipe_', CAST(DIV(event_id,3) % 20 AS STRING)) AS resource, props AS details, ts AS occurred_at FROM events""",
    "edges": """SELECT DIV(p_partkey,20) AS pipeline, p_partkey % 20 AS task, p_partkey % 20 - 1 - p_size % 3 AS depends_on FROM part WHERE p_partkey % 20 - 1 - p_size % 3 >= 0
        UNION SELECT DIV(p_partkey,20), p_partkey % 20, p_partkey % 20 - 2 - p_partkey % 4 FROM part WHERE p_partkey % 20 - 2 - p_partkey % 4 >= 0""",
    "sql_log": """SELECT p_partkey AS query_id, concat('INSERT INTO out', CAST(p_partkey % 9 AS STRING), ' SELECT * FROM a', CAST(p_size AS STRING), ' JOIN ', lower(p_type), ' ON 1=1 -- FROM hidden') AS sql_text FROM part""",
    "queue": """SELECT concat('run_', CAST(o_orderkey AS STRING)) AS run_id, concat('pipe_', CAST(o_custkey % 100 AS STRING)) AS pipeline_name, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status,
        o_orderdate AS queued_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at, CAST(NULL AS STRING) AS error FROM orders""",
    "pipelines": """SELECT concat('pipe_', CAST(p_partkey AS STRING)) AS pipeline_name, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS schedule FROM part""",
    "tasks": """SELECT DIV(p_partkey,20) AS pipeline, concat('task_', CAST(p_partkey % 20 AS STRING)) AS name, CASE WHEN p_size % 2 = 0 THEN concat('id_', CAST(p_partkey % 20 AS STRING)) END AS id, p_brand AS plugin, p_type AS tag, p_size AS size, p_partkey % 20 AS n FROM part""",
}


def spark_text(name: str) -> str:
    return re.sub(r"DIV\((\w+),(\d+)\)", r"(\1 div \2)", VIEWS[name])


def duck_text(name: str) -> str:
    return re.sub(r"DIV\((\w+),(\d+)\)", r"(\1 // \2)", VIEWS[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of ``sf_dir``; views stay lazy."""
    text = spark_text(name)
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def oracle(sql: str, *views: str) -> str:
    """SQL for DuckDB with the views it uses."""
    if not views:
        return sql
    head = "WITH " + ", ".join(f"{v} AS ({duck_text(v)})" for v in views)
    body = sql.strip()
    return f"{head}, {body[5:]}" if body.upper().startswith("WITH ") else f"{head} {body}"
