"""Edge semantics of the operators on small tables."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.functions import registry
from tidemill.operators import checks, definitions, lineage, runs, table, versions


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- table ---------------------------------------------------------------------------------------

#: The six demo orders, whose summary is known.
ORDERS = [
    (1001, "Acme Retail", "north", 1250.50, "paid"),
    (1002, "Blue Ocean", "south", 980.00, "paid"),
    (1003, "Acme Retail", "north", 410.25, "pending"),
    (1004, "Summit Foods", "west", 2200.00, "paid"),
    (1005, "Delta Stores", "east", 1575.75, "paid"),
    (1006, "Blue Ocean", "south", 640.00, "paid"),
]


def test_demo_orders_give_the_known_summary(spark):
    df = spark.createDataFrame(ORDERS, "order_id int, customer string, region string, amount double, status string")
    curated = table.curate_orders(df)
    got = {(r["scope"], r["name"]): r["value"] for r in table.sales_summary(curated).collect()}
    assert got == {("total", "row_count"): 6, ("total", "total_revenue"): 7056.5, ("total", "high_priority_orders"): 2, ("region", "North"): 1660.75, ("region", "South"): 1620.0, ("region", "East"): 1575.75, ("region", "West"): 2200.0}
    assert table.reconcile_counts(df, curated).first()["status"] == "ok" and table.reconcile_counts(df, df.limit(2)).first()["status"] == "mismatch"


def test_aggregate_defaults_and_errors(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "k string, v int")
    out = table.aggregate(df, ["k"], [{"column": "v"}, {"column": "v", "function": "sum"}], "sum_v DESC", "agg_out")
    assert out.columns == ["k", "count_v", "sum_v"] and [r["k"] for r in out.collect()] == [None, "a"]
    assert spark.table("agg_out").count() == 2
    for group, metrics in (([], [{"column": "v"}]), (["k"], [])):
        with pytest.raises(ValueError):
            table.aggregate(df, group, metrics)


def test_transform_sees_input_columns_only(spark):
    df = spark.createDataFrame([(1,)], "a int")
    out = table.transform(df, [{"name": "b", "sql": "a + 1"}, {"name": "no_sql"}, {"sql": "a"}])
    assert out.columns == ["a", "b"]
    with pytest.raises(Exception, match="b"):
        table.transform(df, [{"name": "b", "sql": "a + 1"}, {"name": "c", "sql": "b + 1"}]).collect()


def test_profile_and_generated_sales(spark):
    a, b = table.generate_sales(spark, 500), table.generate_sales(spark, 500).repartition(7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.filter("quantity NOT BETWEEN 1 AND 10 OR revenue < 0 OR year(sale_date) <> 2024").isEmpty()
    many = table.generate_sales(spark, 20_000)
    assert {(r["category"], r["product"]) for r in many.select("category", "product").distinct().collect()} == {(c, x) for c, own in table.PRODUCTS.items() for x in own}
    for c, low, high in values(many.groupBy("category").agg(F.min("unit_price").alias("low"), F.max("unit_price").alias("high")), "category", "low", "high"):
        least, most = table.PRICES[c]
        assert least <= low < least + 0.02 * (most - least) and most - 0.02 * (most - least) < high <= most
    shares = {d: n / 20_000 for d, n in values(many.groupBy("discount_pct").count(), "discount_pct", "count")}
    assert set(shares) == {0.0, 0.05, 0.1, 0.15, 0.2} and all(abs(x - (3 / 7 if d == 0 else 1 / 7)) < 0.02 for d, x in shares.items())
    assert sorted(map(tuple, table.generate_sales(spark, 500, 7).collect())) != sorted(map(tuple, a.collect()))
    p = table.profile(a, 3)
    assert p["row_count"] == 500 and len(p["sample"]) == 3 and ("revenue", "double") in p["columns"]
    assert list(table.profile(a, show_columns=False, show_sample=False)) == ["row_count"]
    assert [c for c, *_ in values(table.profile_columns(a.select("region")), "column", "nulls")] == ["region"]
    assert table.sales_kpis(spark.createDataFrame([(0, 1.0, 0.1, 5.0)], "quantity int, unit_price double, discount_pct double, revenue double")).first()["revenue_per_unit"] is None


# --- checks --------------------------------------------------------------------------------------


def test_validate_is_strict_and_isolates_errors(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    rules = [
        {"name": "eq", "sql": "SELECT count(*) FROM d", "expect": 2}, {"name": "text", "sql": "SELECT count(*) FROM d", "expect": "2"}, {"name": "first_wins", "sql": "SELECT 5", "expect": 4, "expect_gt": 1},
        {"name": "gt_equal", "sql": "SELECT 5", "expect_gt": 5}, {"name": "lt", "sql": "SELECT 5", "expect_lt": 6}, {"name": "null", "sql": "SELECT max(v) FROM d WHERE v > 9", "expect_gt": 0},
        {"name": "no_row", "sql": "SELECT v FROM d WHERE v > 9"}, {"name": "bad", "sql": "SELECT nope FROM d", "expect": 1}, {"name": "bad_where", "table": "d", "where": "nope > 1", "expect": 0}, {"name": "where", "table": "d", "where": "v > 1", "expect": 1},
        {"name": "run_time", "sql": "SELECT 1 / (v - v) FROM d"},
    ]
    got = {r["check"]: r["status"] for r in checks.validate(spark, [*rules, {"name": "skipped"}], {"d": df}).collect()}
    passed = {"eq", "lt", "where"}
    assert got == {r["name"]: "passed" if r["name"] in passed else "failed" for r in rules}
    assert tuple(checks.totals(checks.validate(spark, rules, {"d": df})).first()) == (3, 8, 11)


def test_errors_are_found_without_running_all_again(spark, tmp_path, monkeypatch):
    """Statements that fail when analysed are set apart before anything runs; those that fail at run time are found by halving."""
    spark.range(1000).selectExpr("id", "id % 7 AS k").write.parquet(f"{tmp_path}/t")
    spark.read.parquet(f"{tmp_path}/t").createOrReplaceTempView("scanned")
    ran, made = [], checks.at_once

    def recorded(session, subqueries):
        df = made(session, subqueries)
        ran.append((len(subqueries), df))
        return df

    monkeypatch.setattr(checks, "at_once", recorded)
    good = {f"m{k}": f"SELECT count_if(k = {k}) FROM scanned" for k in range(7)}
    odd = {"broken": "SELECT nope FROM scanned", "no_table": "SELECT 1 FROM nowhere", "syntax": "SELECT FROM WHERE", "last": "SELECT id FROM scanned ORDER BY id DESC", "literal": "SELECT count(*) FROM scanned WHERE 'order by' = 'order by'", "none": "SELECT id FROM scanned WHERE id < 0 ORDER BY id"}
    got = checks.scalars_of(spark, {**good, **odd})
    assert [n for n, _ in ran] == [len(good) + 3] and all(got[n][2] for n in ("broken", "no_table", "syntax"))
    assert [got[f"m{k}"][0] for k in range(7)] == [143] * 6 + [142] and got["last"][:2] == (999, True) and got["literal"][0] == 1000 and got["none"] == (None, False, None)
    ran.clear()
    metrics = checks.compute_metrics(spark, [{"metric_name": n, "sql": q} for n, q in [*good.items(), ("broken", odd["broken"])]])
    assert sum(r["error"] is None for r in metrics.collect()) == 7 and len(ran) == 1
    plan = ran[0][1]._jdf.queryExecution().executedPlan().toString()
    assert 1 <= len(set(re.findall(r"FileScan parquet \[(.*?)\]", plan))) <= 2
    ran.clear()
    got = checks.scalars_of(spark, {**good, "run_time": "SELECT 1 / max(id - id) FROM scanned"})
    assert got["run_time"][2] and not any(got[n][2] for n in good) and len(ran) <= 2 * 3 + 1 and sum(n for n, _ in ran[1:]) <= 2 * 8
    assert checks.scalars(spark, [{"name": "a", "table": "scanned", "where": "id > 1"}, {"name": "b", "table": "scanned", "where": "1 / (id - id) > 0"}])["a"] == (998, True, None)


def test_gate_coerces_and_bounds_are_inclusive(spark):
    assert checks.meets(5, "5.0") and checks.meets("a", "a") and not checks.meets(None, 5) and checks.meets(5, None, 5, 5)
    assert not checks.meets("x", None, 1) and not checks.meets(None, None, None, 3) and checks.meets(None) and checks.meets(5, 5, 9, 9)
    assert [checks.expectation(3), checks.expectation(None, 1, 2), checks.expectation(None, None, 2), checks.expectation()] == ["== 3", ">= 1 and <= 2", "<= 2", "any"]
    gate = checks.quality_gate(spark, [{"name": "a", "sql": "SELECT 1", "expect_min": 1}, {"name": "b", "sql": "SELECT 1 WHERE 1 = 0", "expect_min": 0}])
    assert values(gate, "check_name", "passed") == [("a", True), ("b", False)] and not checks.gate_passes(gate) and checks.gate_passes(gate.filter("passed"))


def test_rules_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (-1, None), (None, " ")], "n int, s string")
    got = values(checks.rule_check(df, [{"field": "s", "type": "not_null"}, {"field": "n", "type": "positive"}, {"field": "s", "type": "not_blank"}]), "field", "rule", "violations")
    assert got == [("n", "positive", 1), ("s", "not_blank", 1), ("s", "not_null", 1)]
    (tmp_path / "a.yaml").write_text("metric_name: ' total '\nsql: SELECT count(*) FROM d\nowner: me")
    (tmp_path / "b.yaml").write_text("metric_name: x")
    (tmp_path / "c.yaml").write_text("a: [")
    loaded = checks.load_metrics(spark, str(tmp_path))
    assert loaded.count() == 3 and values(checks.list_metrics(loaded), "metric_name", "description", "owner") == [("total", "", "me")]
    assert values(checks.compute_metrics(spark, loaded, {"d": df}), "metric_name", "value", "error") == [("total", 3.0, None)]


# --- lineage -------------------------------------------------------------------------------------


def test_sql_lineage_reads_every_table(spark):
    texts = [
        (1, "INSERT INTO s.out SELECT * FROM a JOIN b JOIN c ON 1=1 -- FROM hidden\n/* FROM x */ LEFT JOIN `d` ON true"),
        (2, "create or replace table if not exists T as select * from T join a join A"),
        (3, "SELECT extract(day FROM ts) FROM a"),
        (4, None),
    ]
    got = values(lineage.sql_lineage(spark.createDataFrame(texts, "id int, q string"), "q", "id"), "id", "direction", "asset_uri")
    uri = lineage.LOCAL
    assert got == sorted([(1, "writes_to", uri + "s.out"), *((1, "reads_from", uri + x) for x in "abcd"), (2, "writes_to", uri + "T"), (2, "reads_from", uri + "a"), (2, "reads_from", uri + "A"), (3, "reads_from", uri + "ts"), (3, "reads_from", uri + "a")], key=repr)


def test_catalog_search_and_types(spark):
    df = spark.createDataFrame([("p", "t", "reads_from", "gcs://a_b"), ("p", "t", "writes_to", "gcs://axb"), ("q", "t", "reads_from", "ftp://z"), ("q", "t", "reads_from", "plain")], "pipeline_name string, task_name string, direction string, asset_uri string").withColumn("recorded_at", F.lit(1))
    assert values(lineage.catalog_assets(df, "A_B"), "asset_uri") == [("gcs://a_b",)]
    assert values(lineage.catalog_assets(df), "asset_uri", "asset_type") == [("ftp://z", "Ftp"), ("gcs://a_b", "GCS"), ("gcs://axb", "GCS"), ("plain", "Unknown")]
    assert lineage.asset_detail(df, "none").count() == 0 and lineage.search_lineage(df, "FTP").count() == 2


# --- runs and costs ------------------------------------------------------------------------------


def test_sla_boundary_and_ties(spark):
    df = spark.createDataFrame([("p", 60.0), ("p", 60.1), ("q", 99.0)], "pipeline_name string, duration_seconds double")
    assert runs.sla_violations(df, spark.createDataFrame([("p", 1.0)], "pipeline_name string, max_duration_minutes double")).count() == 1
    t = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    events = spark.createDataFrame([("p", f"r{d}", "s", t[d]) for d in range(7)] + [("p", "r6", "twin", t[6])], "pipeline_name string, run_id string, status string, updated_at timestamp")
    assert values(runs.run_history(events, "p"), "run_id", "status") == [("r2", "s"), ("r3", "s"), ("r4", "s"), ("r5", "s"), ("r6", "s"), ("r6", "twin")]
    assert runs.latest_by(events, ["pipeline_name"], "updated_at").first()["status"] == "twin"


def test_costs_keep_raw_teams_apart(spark):
    df = spark.createDataFrame([("p", None, 1.0), ("p", "unassigned", 2.0), ("q", None, 3.0)], "pipeline_name string, team string, duration_seconds double").withColumns({"task_count": F.lit(2), "recorded_at": F.lit(1)})
    costed = runs.run_cost(df, 0.5)
    assert values(costed, "estimated_cost_usd") == [(1.0,), (2.0,), (3.0,)]
    assert values(runs.cost_by_team(costed), "team", "runs", "cost") == [("unassigned", 1, 2.0), ("unassigned", 2, 4.0)]


def test_metrics_text_escapes_labels(spark):
    e = spark.createDataFrame([('a"b\\c\nd', "ok")], "pipeline_name string, status string")
    q = spark.createDataFrame([("p", "t", False)], "pipeline_name string, task_name string, passed boolean")
    lines = [r["value"] for r in runs.metrics_text(e, q, e.limit(0)).collect()]
    assert 'dp_pipeline_runs_total{pipeline="a\\"b\\\\c\\nd",status="ok"} 1' in lines and 'dp_quality_check_results_total{pipeline="p",task="t",result="failed"} 1' in lines
    assert sum(x.startswith("# TYPE") for x in lines) == 3


def test_states_orphans_audit_and_errors(spark):
    t = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    events = spark.createDataFrame([("r", "p", "queued", t[0], None), ("r", "p", "running", t[1], None), ("r", "p", "failed", t[2], "boom"), ("s", "p", "queued", t[0], None)], "run_id string, pipeline_name string, status string, updated_at timestamp, error string")
    got = {r["run_id"]: r for r in runs.fold_run_state(events).collect()}
    assert (got["r"]["status"], got["r"]["started_at"], got["r"]["completed_at"], got["r"]["error"]) == ("failed", t[1], t[2], "boom") and got["s"]["completed_at"] is None
    fixed = runs.recover_orphans(events.withColumn("completed_at", F.lit(None).cast("timestamp")), F.lit(t[4]))
    assert fixed.filter("recovered").count() == 3 and fixed.filter("status IN ('queued', 'running')").isEmpty()
    log = spark.createDataFrame([(1, "a", "x", "r", '{"k": 1}', t[0]), (2, "a", "x", "r", "not json", t[1])], "event_id int, event_type string, actor string, resource string, details string, occurred_at timestamp")
    out = runs.audit_events(log, actor="x").withColumn("k", F.try_variant_get("details_json", "$.k", "int")).drop("details_json").collect()
    assert [(r["event_id"], r["k"], r["details"]) for r in out] == [(2, None, "not json"), (1, 1, '{"k": 1}')]
    errors = spark.createDataFrame([("r", "b", "two"), ("r", "a", "one"), ("r", "c", None)], "run_id string, task_name string, error string")
    assert runs.error_summary(errors, ["run_id"]).first()["message"] == "a: one; b: two"


# --- versions ------------------------------------------------------------------------------------


def test_versions(spark):
    rows = [(1, "p", "a\nb\nb", 1), (2, "p", "a\nb\nb", 2), (3, "p", "b\nc", 3), (4, "q", "a", 4)]
    df = spark.createDataFrame(rows, "version_id int, pipeline_name string, content string, saved_seq int")
    assert values(versions.dedupe_versions(df), "version_id") == [(1,), (3,), (4,)]
    assert values(versions.new_versions(df.filter("version_id = 1"), df.filter("version_id > 1")), "version_id") == [(3,), (4,)]
    got = versions.version_diff(df, with_lines=True)
    assert values(got, "version_id", "added", "removed") == [(2, 0, 0), (3, 1, 2)]
    assert values(got.filter("version_id = 3"), "added_lines", "removed_lines") == [(["c"], ["a", "b"])]
    assert versions.version_content(df, "q", 1).count() == 0


# --- definitions ---------------------------------------------------------------------------------


def test_levels_and_cycles(spark):
    diamond = [(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 3, 2)]
    chain = [(2, k + 1, k) for k in range(12)]
    cycle = [(3, 1, 0), (3, 2, 1), (3, 1, 2), (3, 3, 2)]
    df = spark.createDataFrame(diamond + chain + cycle, "pipeline int, task int, depends_on int")
    got = {(r["pipeline"], r["task"]): (r["level"], r["cyclic"]) for r in definitions.topo_levels(df).collect()}
    assert [got[1, k][0] for k in range(4)] == [0, 1, 1, 2] and [got[2, k][0] for k in range(13)] == list(range(13))
    assert got[3, 0] == (0, False) and all(got[3, k] == (None, True) for k in (1, 2, 3))


def levels(df):
    return {(r["pipeline"], r["task"]): (r["level"], r["cyclic"]) for r in df.collect()}


def brute_levels(edges):
    """Longest path by walking: by graph and task."""
    nodes = {(p, t) for p, a, b in edges for t in (a, b) if t is not None}
    before = {n: {(p, b) for p, a, b in edges if (p, a) == n and b is not None} for n in nodes}
    found = {}
    for _ in range(len(nodes) + 1):
        found |= {n: max((found[b] + 1 for b in before[n]), default=0) for n in nodes if n not in found and all(b in found for b in before[n])}
    return {n: (found.get(n), n not in found) for n in nodes}


def test_all_ways_give_the_same_levels(spark):
    rng = random.Random(4)
    edges = [("chain", f"t{k + 1}", f"t{k}") for k in range(40)] + [(None, "x", "y"), (None, None, "z"), ("loop", "s", "s"), ("loop", "after", "s"), ("only", "one", None), ("twice", "b", "a"), ("twice", "b", "a")]
    for g in range(12):
        n = rng.randint(2, 14)
        edges += [(f"g{g}", f"t{b}", f"t{a}") for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)) if g % 3 == 0 or a < b]
    df = spark.createDataFrame(edges, "pipeline string, task string, depends_on string")
    want = brute_levels(edges)
    assert levels(definitions.levels_within(df)) == want
    named = {k: v for k, v in want.items() if k[0] is not None}
    for way in (definitions.doubled_levels, definitions.peeled_levels):
        assert levels(way(df.filter("pipeline IS NOT NULL"))) == named
    assert levels(definitions.topo_levels(df, small=20)) == want and levels(definitions.topo_levels(df.limit(0))) == {}


def test_deep_graphs_take_few_rounds_and_hubs_are_peeled(spark, monkeypatch):
    rounds, real = [], definitions.stored
    monkeypatch.setattr(definitions, "stored", lambda df, name: rounds.append(name) or real(df, name))
    chain = spark.range(100_000).selectExpr("1 AS pipeline", "id + 1 AS task", "id AS depends_on")
    got = definitions.topo_levels(chain)
    assert got.filter("cyclic OR level <> task").isEmpty() and got.count() == 100_001 and rounds.count("paths") - 1 <= 20
    monkeypatch.setattr(definitions, "WIDEST", 2)
    hub = spark.range(300).selectExpr("1 AS pipeline", "1000 AS task", "id AS depends_on").unionByName(spark.range(300).selectExpr("1 AS pipeline", "id + 2000 AS task", "1000 AS depends_on"))
    called, peeled = [], definitions.peeled_levels
    monkeypatch.setattr(definitions, "peeled_levels", lambda df: called.append(1) or peeled(df))
    assert {r["level"]: r["count"] for r in definitions.topo_levels(hub, small=10).groupBy("level").count().collect()} == {0: 300, 1: 1, 2: 300} and called


def test_inventory_and_errors(spark, tmp_path):
    (tmp_path / "good.yaml").write_text("pipeline_name: p\ntags: [x]\nschedule: {minute: 5, week: 1}\ntasks:\n- {name: a, id: i1, plugin: duckdb}\n- {name: b, plugin: python, depends_on: [i1, zz, b]}\n- {name: b, plugin: python}\n")
    (tmp_path / "bad.yaml").write_text("tasks: []")
    (tmp_path / "ugly.yaml").write_text("a: [")
    found = definitions.pipeline_inventory(spark, str(tmp_path))
    assert sorted(r["error_type"] or "" for r in found.collect())[0] == "" and found.filter("error IS NULL").count() == 1
    tasks = found.filter("error IS NULL").select(F.col("pipeline_name").alias("pipeline"), "tags", F.inline("tasks"))
    schedules = found.filter("error IS NULL").select(F.col("pipeline_name").alias("pipeline"), "schedule")
    assert values(definitions.definition_errors(tasks, schedules), "error", "detail") == [("duplicate_name", "b"), ("self_dependency", "b"), ("unknown_dependency", "b -> zz"), ("unsupported_schedule_key", "week")]
    assert values(definitions.template_metadata(tasks), "task_count", "plugins", "tags") == [(3, ["duckdb", "python"], ["x"])]
    assert ("p", "a", "b") in values(definitions.task_edges(tasks), "pipeline", "source", "target")
    assert definitions.operators_for(spark, "aggregate").count() == 1 and definitions.operators_for(spark, "teleport").count() == 0


# --- functions -----------------------------------------------------------------------------------


def test_user_functions(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    top = registry.python_step(df, lambda pdf, n: pdf.nlargest(n, "v"), {"n": 1}, "k string, v int", ["k"])
    assert values(top, "k", "v") == [("a", 2), ("b", 5)]
    assert registry.python_step(df, lambda d, least: d.filter(F.col("v") >= least), {"least": 2}).count() == 2
    registry.register_udf(spark, "shout", lambda s: s.str.upper())
    registry.register_udf(spark, "plus_one", lambda v: v + 1, "int", vectorized=False)

    class Twice:
        def eval(self, x: int):
            yield (x,)
            yield (x * 2,)

    registry.register_udtf(spark, "twice", Twice, "x: int")
    assert spark.sql("SELECT shout('a') AS a, plus_one(1) AS b").first() == ("A", 2) and spark.sql("SELECT * FROM twice(4)").count() == 2

    @registry.operator("keep_k")
    def keep_k(d, k):
        return d.filter(F.col("k") == k)

    assert registry.run_operator("keep_k", df, {"k": "a"}).count() == 2 and "keep_k" in registry.operator_names()
    with pytest.raises(KeyError):
        registry.run_operator("nope", df)
    registry.operator("not_a_table")(lambda d: 1)
    with pytest.raises(TypeError):
        registry.run_operator("not_a_table", df)
