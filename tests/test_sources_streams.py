"""Round trips of sources and sinks, and streams over temporary folders."""

import http.server
import io
import json
import threading
import time
import urllib.parse

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.plans.server import rows_served
from tidemill.sources import external, files, requests, watch
from tidemill.streaming import streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "k int, v string")
    for fmt in ("csv", "json", "parquet", "orc"):
        assert files.write_sink(df, f"{tmp_path}/x.{fmt}", fmt) == 3
        back = files.read_source(spark, f"{tmp_path}/x.{fmt}", schema=None if fmt == "csv" else df.schema, view=f"x_{fmt}")
        assert rows(back.select("k", "v")) == rows(df) and spark.table(f"x_{fmt}").count() == 3
    assert [files.format_of(p) for p in ("a/b.csv.gz", "c.JSON", "d", "e.parquet/")] == ["csv", "json", "parquet", "parquet"]
    assert files.export_csv(df, f"{tmp_path}/sorted", ["k"]) == 3
    assert [r["k"] for r in files.read_source(spark, f"{tmp_path}/sorted", "csv").collect()] == [1, 2, 3]
    found = files.register_sources(spark, {"one": f"{tmp_path}/x.parquet", "two": {"path": f"{tmp_path}/x.csv", "format": "csv", "schema": "k long, v string"}})
    assert found["two"].schema["k"].dataType.simpleString() == "bigint" and spark.sql("SELECT * FROM one JOIN two USING (k)").count() == 3


def test_text_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "in" / "b.txt").write_text("three")
    (tmp_path / "in" / "deep" / "c.txt").write_text("four\n")
    got = files.read_text_files(spark, f"{tmp_path}/in/a.txt").first()
    assert got["content"] == "one\ntwo\n" and got["size"] == 8
    assert files.list_files(spark, f"{tmp_path}/in", "*.txt").count() == 2 and files.list_files(spark, f"{tmp_path}/in", "*.txt", True).count() == 3
    merged = files.merge_files(spark, [f"{tmp_path}/in/a.txt", f"{tmp_path}/in/b.txt", f"{tmp_path}/none.txt"], f"{tmp_path}/all")
    assert sorted(r["lines"] for r in merged.collect()) == [1, 2] and spark.read.text(f"{tmp_path}/all").count() == 3
    assert files.merge_files(spark, [f"{tmp_path}/none"], f"{tmp_path}/x").count() == 0
    files.write_text(spark.createDataFrame([("more",)], "v string"), f"{tmp_path}/all", "append")
    assert spark.read.text(f"{tmp_path}/all").count() == 4


def test_history_is_pruned_by_date(spark, tmp_path):
    df = spark.sql("SELECT id, TIMESTAMP '2024-01-01' + make_dt_interval(CAST(id AS INT)) AS occurred_at FROM range(5)")
    files.append_history(df, str(tmp_path), "audit_log")
    files.append_history(df, str(tmp_path), "audit_log")
    back = files.read_history(spark, str(tmp_path), "audit_log")
    assert back.count() == 10 and back.filter("date = DATE '2024-01-03'").count() == 2
    assert "PartitionFilters: [isnotnull(date" in back.filter("date = DATE '2024-01-03'")._jdf.queryExecution().toString()


def test_jdbc_round_trip(spark, tmp_path):
    conn = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.createDataFrame([(k, f"n{k}", k / 2) for k in range(50)], "ID int, NAME string, X double")
    external.jdbc_load(df, conn, "T1", "overwrite", 10, 2)
    external.jdbc_load(df.limit(5), conn, "T1")
    assert external.jdbc_query(spark, conn, "SELECT ID, X FROM T1 WHERE ID < 10").count() == 15
    split = external.jdbc_query(spark, conn, "SELECT * FROM T1", "ID", 0, 50, 4)
    assert split.rdd.getNumPartitions() == 4 and split.count() == 55
    assert external.jdbc_extract(spark, conn, "SELECT * FROM T1", f"{tmp_path}/out") == 55
    external.warehouse_load(df, conn, "T2", "replace")
    external.warehouse_load(df, conn, "T2", "append")
    assert external.jdbc_query(spark, conn, "SELECT * FROM T2").count() == 100


def test_warehouse_types_and_urls(spark):
    df = spark.sql("SELECT 1 AS i, true AS b, CAST(1 AS DECIMAL(9,2)) AS d, 1.5D AS f, repeat('x', 300) AS s, repeat('y', 5000) AS t, CAST(NULL AS STRING) AS n, DATE '2024-01-01' AS day")
    assert external.warehouse_ddl(df) == [("i", "INTEGER"), ("b", "INTEGER"), ("d", "FLOAT"), ("f", "FLOAT"), ("s", "VARCHAR(1000)"), ("t", "VARCHAR(4000)"), ("n", "VARCHAR(255)"), ("day", "VARCHAR(255)")]
    assert external.jdbc_url({"dialect": "postgres", "database": "d"}) == "jdbc:postgresql://localhost:5432/d" and external.quoted('s.t"x') == '"s"."t""x"'


def test_kafka_messages(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    sent = external.kafka_encode(df, "k", 3)
    assert sent.columns == ["key", "value", "partition"]
    raw = sent.unionByName(spark.createDataFrame([("9", "no json", 3)], sent.schema)).withColumns({"offset": F.lit(5), "value": F.col("value").cast("binary")})
    assert rows(external.kafka_decode(raw, "k int, v string").select("value.k", "value.v", "offset", "partition")) == sorted([(1, "a", 5, 3), (2, None, 5, 3), (None, None, 5, 3)], key=repr)
    assert external.kafka_decode(raw).filter("value IS NULL").count() == 1


class Pages(http.server.BaseHTTPRequestHandler):
    failures = 0

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        page = int(urllib.parse.parse_qs(url.query).get("page", ["0"])[0])
        status = 404 if url.path == "/missing" else 200
        if url.path == "/shaky" and Pages.failures < 2:
            Pages.failures, status = Pages.failures + 1, 500
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps([{"id": 10 * page + k, "key": self.headers.get("X-Key")} for k in range(2)]).encode())

    def log_message(self, *a):
        pass


def test_http_pages(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    asked = [{"url": f"{base}/items", "params": {"page": k}, "headers": {"X-Key": "s"}} for k in range(3)] + [{"url": f"{base}/missing"}, {"url": f"{base}/shaky"}]
    try:
        df = external.http_json_source(spark, asked)
        assert df.rdd.getNumPartitions() == 5
        got = df.collect()
        assert sorted(r["status"] for r in got) == [200, 200, 200, 200, 404] and sum(r["error"] is not None for r in got) == 1
        parsed = external.json_rows(spark.createDataFrame(got, df.schema), "id int, key string")
        many = spark.createDataFrame([(f"{base}/items", {"page": str(k)}) for k in range(5)] + [(f"{base}/missing", None)], "url string, params map<string,string>")
        assert sorted(r["status"] for r in external.http_json_source(spark, many).collect()) == [200] * 5 + [404]
        assert sorted(r["id"] for r in parsed.filter("key = 's'").collect()) == [0, 1, 10, 11, 20, 21]
    finally:
        server.shutdown()


def test_requests_are_answered_once(spark, tmp_path):
    with rows_served({k: (f"n{k}", -1.0 if k in (3, 30) else 1.0) for k in range(1, 41)}) as (base, served):
        asked = spark.createDataFrame([(f"{base}/x", {"key": str(k)}) for k in [*range(1, 41), 5, 5]] + [(None, None), ("http://127.0.0.1:9/none", None)], "url string, params map<string,string>")
        first = requests.fetch_all(spark, asked, f"{tmp_path}/a", tries=1, per_task=7)
        assert first.count() == 41 and first.filter("status = 500").count() == 3 and set(served.values()) == {1}
        got = {r["url"].rsplit("=", 1)[-1]: r for r in requests.fetch_all(spark, asked, f"{tmp_path}/a", tries=3, per_task=7, wait=0.1).collect()}
        assert len(got) == 41 and {k: n for k, n in served.items() if n > 1} == {10: 2, 20: 2, 40: 2}
        assert got["3"]["status"] == got["30"]["status"] == 404 and got["3"]["error"] and got["10"]["attempts"] == 2 and got["10"]["body"]
        assert got["http://127.0.0.1:9/none"]["attempts"] == 3 and got["http://127.0.0.1:9/none"]["error"]
        requests.fetch_all(spark, asked, f"{tmp_path}/a", tries=3)
        assert sum(served.values()) == 43
    assert requests.fetch_all(spark, asked.limit(0), f"{tmp_path}/b").count() == 0


def test_file_sensor_skips_old_files(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    spark.range(3).write.mode("append").parquet(str(folder))
    time.sleep(1.2)
    since = spark.sql("SELECT current_timestamp()").first()[0]
    time.sleep(0.2)
    spark.range(10, 15).write.mode("append").parquet(str(folder))
    streams.file_arrivals(spark, str(folder), "id long", lambda df, n: seen.extend(r["id"] for r in df.collect()), f"{tmp_path}/c", since=since, every=None).awaitTermination()
    assert sorted(seen) == list(range(10, 15))
    streams.file_arrivals(spark, str(folder), "id long", lambda df, n: seen.append(-1), f"{tmp_path}/c", since=since, every=None).awaitTermination()
    assert -1 not in seen


def test_log_tail_and_completions(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "run_1.log").write_text("  a \t\r\n\n\t b\n \t \r\n")
    assert rows(streams.drain(streams.tail_lines(spark, f"{tmp_path}/logs"))) == [("a", "run_1"), ("b", "run_1")]
    spark.createDataFrame([("r1", "p", "completed"), ("r2", "p", "failed"), ("r3", "q", "completed")], "run_id string, pipeline_name string, status string").write.parquet(f"{tmp_path}/runs")
    asked = spark.createDataFrame([("p", "x"), ("p", "y")], "pipeline_name string, downstream string")
    fired = streams.drain(streams.completion_fires(streams.table_stream(spark, f"{tmp_path}/runs"), asked))
    assert rows(fired.select("run_id", "downstream")) == [("r1", "x"), ("r1", "y")]


def test_log_tail_follows_growing_files(spark, tmp_path):
    logs, log = tmp_path / "logs", tmp_path / "logs" / "run_1.log"
    logs.mkdir()
    log.write_text("a\nbe")

    def more():
        streams.tail_lines(spark, str(logs)).writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        return rows(spark.read.schema("line string, run_id string").parquet(f"{tmp_path}/out"))

    assert more() == [("a", "run_1")]
    with log.open("a") as f:
        f.write("gin\n\n c \nd")
    (logs / "run_2.log").write_text("x\n")
    assert more() == [("a", "run_1"), ("begin", "run_1"), ("c", "run_1"), ("x", "run_2")]
    assert len(more()) == 4
    log.write_text("n\n")  # cut: read from its begin
    assert ("n", "run_1") in more()


@given(st.lists(st.integers(0, 60)), st.text("ab\n", max_size=60))
def test_lines_come_once(cuts, text):
    data = text.encode()
    ends = [0, *sorted(min(c, len(data)) for c in cuts), len(data)]
    got = [line for a, b in zip(ends, ends[1:]) for line in watch.lines_ended(io.BytesIO(data), a, b)]
    assert got == data.split(b"\n")[:-1]


def test_file_sensor_fires_on_changes(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "old.csv").write_text("1")

    def poll():
        seen.clear()
        watched = streams.file_changes(spark, str(folder), "*.csv")
        watched.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda df, n: seen.extend((r["path"].rsplit("/", 1)[-1], r["size"]) for r in df.collect())).trigger(availableNow=True).start().awaitTermination()
        return sorted(seen)

    assert poll() == []
    (folder / "old.csv").write_text("12")
    (folder / "new.csv").write_text("abc")
    (folder / "other.txt").write_text("abc")
    assert poll() == [("new.csv", 3), ("old.csv", 2)]
    assert poll() == []


def test_positions_do_not_grow_with_the_files(spark, tmp_path):
    """100,000 watched files: a position is a few bytes, and a batch finds the few that changed."""
    folder, seen = tmp_path / "many", []
    for k in range(100):
        (folder / f"d{k}").mkdir(parents=True)
        for j in range(1000):
            (folder / f"d{k}" / f"{j}.log").write_bytes(b"")

    def poll():
        seen.clear()
        watched = streams.file_changes(spark, str(folder), "*.log", existing=True, recursive=True, settle=0.2)
        count = lambda df, n: seen.extend(df.agg(F.count(F.lit(1)), F.sum("size")).collect())
        watched.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(count).trigger(availableNow=True).start().awaitTermination()
        return [sum(x or 0 for x in column) for column in zip(*seen)]

    assert poll() == [100_000, 0] and poll() == [0, 0]
    for k in (3, 50, 99):
        (folder / f"d{k}" / "7.log").write_text("grown")
    (folder / "new.log").write_text("n")
    assert poll() == [4, 16]
    assert max(f.stat().st_size for f in (tmp_path / "c" / "offsets").iterdir() if f.name.isdigit()) < 2000


def test_a_run_fires_once(spark, tmp_path):
    asked = spark.createDataFrame([("p", "x"), ("p", "y")], "pipeline_name string, downstream string")
    for day, run in ((1, "r1"), (1, "r2"), (2, "r1"), (30, "r3"), (31, "r3")):
        spark.createDataFrame([(run, "p", "completed", f"2024-01-{day:02d}")] * 2 + [("r9", "p", "failed", "2024-01-01")], "run_id string, pipeline_name string, status string, updated_at string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    fired = streams.drain(streams.completion_fires(streams.table_stream(spark, f"{tmp_path}/in", per_trigger=1), asked, "5 days"))
    assert rows(fired.select("run_id", "downstream")) == [(r, d) for r in ("r1", "r2", "r3") for d in ("x", "y")]


def test_late_rows_are_dropped(spark, tmp_path):
    make = lambda *days: spark.createDataFrame([(d, "p", "ok") for d in days], "updated_at string, pipeline_name string, status string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    for batch in (make("2024-01-01", "2024-01-02"), make("2024-01-10"), make("2024-01-11"), make("2024-01-01", "2024-01-11")):
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    counts = streams.run_counts_stream(streams.table_stream(spark, f"{tmp_path}/in", per_trigger=1))
    assert rows(streams.drain(counts).select(F.to_date("window_start").cast("string"), "count")) == [("2024-01-01", 1), ("2024-01-02", 1)]


def test_quality_gate_of_a_stream(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    checks = [{"name": "n", "sql": "SELECT count(*) FROM data", "expect": 5}, {"name": "max", "table": "data", "where": "id > 3", "expect": 0}]
    streams.quality_stream(streams.table_stream(spark, f"{tmp_path}/in"), checks, f"{tmp_path}/h", f"{tmp_path}/c", pipeline="p").awaitTermination()
    assert rows(files.read_history(spark, f"{tmp_path}/h", "quality_results").select("check_name", "passed")) == [("max", False), ("n", True)]


@pytest.mark.parametrize("call", [lambda s: external.bq_query(s, "p", "SELECT 1"), lambda s: external.kafka_consume(s, "localhost:9", "t")])
def test_absent_connectors_fail_plainly(spark, call):
    with pytest.raises(Exception, match="(?i)bigquery|kafka"):
        call(spark).collect()
