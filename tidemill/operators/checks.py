"""Validation checks, quality gates, field rules and named metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.addresses import with_files
from tidemill.sources.files import bind_inputs
from tidemill.sources.scratch import stored

VALIDATION = "check string, actual string, status string, error string"
QUALITY = "run_id string, pipeline_name string, task_name string, check_name string, passed boolean, actual_value string, expected_value string, error string, checked_at timestamp"
METRICS = "metric_name string, value double, error string, computed_at timestamp"


#: Statements that one query computes at once.
FUSED = 100


#: What a statement can fail with; an error within a subquery comes as the JVM's own, wrapped.
FAILURES = (PySparkException, Py4JJavaError)


def _message(e: Exception) -> str:
    if isinstance(e, Py4JJavaError):
        cause = e.java_exception
        while cause.getCause() is not None:
            cause = cause.getCause()
        return (cause.getMessage() or cause.toString()).splitlines()[0]
    return (str(e).splitlines() or [type(e).__name__])[0]


def halved(names: list[str], run: Callable[[list[str]], dict[str, tuple]]) -> dict[str, tuple]:
    """What ``run`` finds for all names at once. If it fails, for each half of them, until the names that fail stand alone: their error is the result.

    One failing name among n costs about twice the logarithm of n runs, of ever fewer names.
    """
    if not names:
        return {}
    try:
        return run(names)
    except FAILURES as e:
        if len(names) == 1:
            return {names[0]: (None, False, _message(e))}
    half = len(names) // 2
    return halved(names[:half], run) | halved(names[half:], run)


def at_once(spark: SparkSession, subqueries: list[str]) -> DataFrame:
    """One row of all scalar subqueries."""
    return spark.sql(f"SELECT {', '.join(subqueries)}")


def scalars_of(spark: SparkSession, queries: Mapping[str, str]) -> dict[str, tuple]:
    """(value, found, error) by name of each SQL query: the first value of its first row, in its own order if it has one.

    Each query is analysed first, which reads no table; those that fail there are set apart. The others are subqueries of one query, so
    that Catalyst can merge those that aggregate one view alike and reuse what they share. An error while that query runs is
    found by halving, so it concerns its own query alone. Queries may address files (:func:`with_files`).
    """
    out, subqueries = {}, {}
    for name, sql in queries.items():
        try:
            text = with_files(spark, sql).strip().rstrip(";")
            rows = spark.sql(text)._jdf.queryExecution().analyzed().maxRows()
            # of a single row any is the first, and an aggregate over it can be merged with others; a limit keeps the order of several
            single = rows.isDefined() and rows.get() <= 1
            subqueries[name] = f"(SELECT first(struct(*)) FROM ({text}\n))" if single else f"(SELECT struct(*) FROM ({text}\n) LIMIT 1)"
        except (PySparkException, ValueError) as e:
            out[name] = (None, False, _message(e))

    def run(names: list[str]) -> dict[str, tuple]:
        row = at_once(spark, [subqueries[n] for n in names]).first()
        return {n: (None, False, None) if x is None else (x[0], True, None) for n, x in zip(names, row)}

    good = list(subqueries)
    for k in range(0, len(good), FUSED):
        out |= halved(good[k : k + FUSED], run)
    return out


def scalars(spark: SparkSession, checks: Iterable[Mapping]) -> dict[str, tuple]:
    """(value, found, error) by name of each check.

    A check with ``table`` and ``where`` counts rows; all of one table are counted in one pass. Those with ``sql``: see :func:`scalars_of`.
    """
    out, by_table, by_sql = {}, {}, {}
    for c in checks:
        if c.get("where") and c.get("table"):
            by_table.setdefault(c["table"], {})[c["name"]] = c["where"]
        else:
            by_sql[c["name"]] = c["sql"]
    out |= scalars_of(spark, by_sql)
    for table, own in by_table.items():
        good = []
        for name, where in own.items():
            try:
                spark.table(table).filter(where)
                good.append(name)
            except PySparkException as e:
                out[name] = (None, False, _message(e))

        def run(names: list[str], table=table, own=own) -> dict[str, tuple]:
            row = spark.table(table).agg(*[F.count_if(F.expr(own[n])).alias(str(k)) for k, n in enumerate(names)]).first()
            return {n: (x, True, None) for n, x in zip(names, row)}

        out |= halved(good, run)
    return out


def _named(checks: Iterable[Mapping]) -> list[dict]:
    kept = [dict(c) for c in checks if c.get("sql") or c.get("where")]
    return [c | {"name": c.get("name") or f"check_{k}"} for k, c in enumerate(kept, 1)]


def validate(spark: SparkSession, checks: Iterable[Mapping], views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """check, actual, status and error of each check.

    The first present of ``expect`` (equal), ``expect_gt`` and ``expect_lt`` decides; none: passed. No row, a null under
    a bound, or an error: failed. Checks without a query are left out.
    """
    bind_inputs(spark, views or {})
    checks = _named(checks)
    found, rows = scalars(spark, checks), []
    for c in checks:
        value, present, error = found[c["name"]]
        if error is None and not present:
            error = "the query gave no row"
        ok = error is None
        try:
            if ok and c.get("expect") is not None:
                ok = value == c["expect"]
            elif ok and c.get("expect_gt") is not None:
                ok = value > c["expect_gt"]
            elif ok and c.get("expect_lt") is not None:
                ok = value < c["expect_lt"]
        except TypeError as e:
            ok, error = False, str(e)
        rows.append((c["name"], None if value is None else str(value), "passed" if ok else "failed", error))
    return spark.createDataFrame(rows, VALIDATION)


def totals(results: DataFrame, passed: str = "status = 'passed'") -> DataFrame:
    return results.agg(F.count_if(F.expr(passed)).alias("passed"), F.count_if(F.expr(f"NOT ({passed})")).alias("failed"), F.count(F.lit(1)).alias("total"))


def _number(x):
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def meets(actual, expect=None, low=None, high=None) -> bool:
    """Equality (as numbers where both are), else inclusive bounds; what is no number is within no bound."""
    if expect is not None:
        a, b = _number(actual), _number(expect)
        return a == b if a is not None and b is not None else actual == expect
    a = _number(actual)
    return all(a is not None and (a >= float(x) if lower else a <= float(x)) for x, lower in ((low, True), (high, False)) if x is not None)


def expectation(expect=None, low=None, high=None) -> str:
    if expect is not None:
        return f"== {expect}"
    return " and ".join(f"{sign} {x}" for sign, x in ((">=", low), ("<=", high)) if x is not None) or "any"


def quality_gate(spark: SparkSession, checks: Iterable[Mapping], views: Mapping[str, DataFrame] | None = None, run_id: str = "", pipeline: str = "", task: str = "") -> DataFrame:
    """A ``quality_results`` row per check; see :func:`meets`. No row counts as null, an error as failed."""
    bind_inputs(spark, views or {})
    checks = _named(checks)
    found, rows = scalars(spark, checks), []
    for c in checks:
        value, _, error = found[c["name"]]
        limits = (c.get("expect"), c.get("expect_min"), c.get("expect_max"))
        rows.append((run_id, pipeline, task, c["name"], error is None and meets(value, *limits), None if value is None else str(value), expectation(*limits), error))
    return spark.createDataFrame(rows, QUALITY.rsplit(",", 1)[0]).withColumn("checked_at", F.current_timestamp())


def gate_passes(results: DataFrame) -> bool:
    """Whether a step passes: no check failed."""
    return results.filter("NOT passed").isEmpty()


#: How each field rule is broken.
RULES = {"not_null": lambda c: c.isNull(), "positive": lambda c: ~(c > 0), "non_negative": lambda c: ~(c >= 0), "not_blank": lambda c: F.trim(c.cast("string")) == ""}


def rule_check(df: DataFrame, rules: Iterable[Mapping]) -> DataFrame:
    """field, rule, violations and passed of rules {field, type}, all in one pass."""
    rules = list(rules)
    counts = df.agg(*[F.count_if(RULES[r["type"]](F.col(r["field"]))).alias(str(k)) for k, r in enumerate(rules)])
    cells = [F.struct(F.lit(r["field"]).alias("field"), F.lit(r["type"]).alias("rule"), F.col(str(k)).alias("violations"), (F.col(str(k)) == 0).alias("passed")) for k, r in enumerate(rules)]
    return counts.select(F.inline(F.array(*cells)))


# --- named metrics ---------------------------------------------------------------------------

_DEFINITION = "path string, metric_name string, sql string, description string, owner string, error string"


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric definitions from YAML files, one a file; what is not valid has an error."""
    from tidemill.sources.files import decode_files

    def decode(batches):
        import pandas as pd
        import yaml

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    d = yaml.safe_load(content)
                    d = d if isinstance(d, dict) else {}
                    text = lambda k: str(d.get(k) or "").strip()  # noqa: B023,E731
                    missing = [k for k in ("metric_name", "sql") if not text(k)]
                    rows.append((path, text("metric_name"), text("sql"), text("description"), text("owner"), f"missing: {', '.join(missing)}" if missing else None))
                except yaml.YAMLError as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _DEFINITION.split(", ")])

    return decode_files(spark, path, decode, _DEFINITION)


def list_metrics(definitions: DataFrame) -> DataFrame:
    """Valid definitions without their SQL, in order of their files. They are written first: a sort reads its input twice, and files would be decoded twice."""
    valid = stored(definitions.filter("error IS NULL").select("path", "metric_name", "description", "owner"), "metrics")
    return valid.orderBy("path").drop("path")


def compute_metrics(spark: SparkSession, definitions: DataFrame | Iterable[Mapping], views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Value of each metric: the first cell as a double; null if there is none; errors as text."""
    bind_inputs(spark, views or {})
    listed = definitions.filter("error IS NULL").select("metric_name", "sql").collect() if isinstance(definitions, DataFrame) else definitions
    listed = [(d["metric_name"], d["sql"]) for d in listed]
    found = scalars_of(spark, {str(k): sql for k, (_, sql) in enumerate(listed)})
    rows = [(name, _number(found[str(k)][0]), found[str(k)][2]) for k, (name, _) in enumerate(listed)]
    return spark.createDataFrame(rows, METRICS.rsplit(",", 1)[0]).withColumn("computed_at", F.current_timestamp())
