"""Run history, quality, service levels, audit and cost analytics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], ts: str, *ties: str) -> DataFrame:
    """The newest row of each key: one aggregation with partial maxima, no sort. Ties go to the greatest ``ties``, then the greatest row."""
    rest = [c for c in df.columns if c not in (*keys, ts, *ties)]
    order = F.struct(ts, *ties, *[c for c in rest if not dict(df.dtypes)[c].startswith(("map", "variant"))])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def recent_rows(df: DataFrame, filters: Mapping | None = None, ts: str = "updated_at", limit: int = 50, *ties: str) -> DataFrame:
    """The newest rows that equal every filter that is not None."""
    for c, v in (filters or {}).items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    return df.orderBy(F.col(ts).desc_nulls_last(), *ties).limit(limit)


def run_history(runs: DataFrame, pipeline: str | None = None, n: int = 5) -> DataFrame:
    """Last entries of the n runs of latest entry, of one pipeline or of each. Entries of equal time are all returned."""
    own = runs if pipeline is None else runs.filter(F.col("pipeline_name") == pipeline)
    last = own.groupBy("pipeline_name", "run_id").agg(F.max("updated_at").alias("updated_at"))
    top = last.withColumn("_r", F.row_number().over(Window.partitionBy("pipeline_name").orderBy(F.desc("updated_at"), "run_id"))).filter(F.col("_r") <= n).drop("_r")
    return own.join(top, ["pipeline_name", "run_id", "updated_at"]).select(*runs.columns)


def pipeline_names(runs: DataFrame) -> DataFrame:
    return runs.select("pipeline_name").distinct().orderBy("pipeline_name")


def run_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("pipeline_name", "status").agg(F.count(F.lit(1)).alias("count"))


def quality_history(results: DataFrame, pipeline: str, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Newest results of a pipeline, and how many of those passed and failed."""
    rows = recent_rows(results, {"pipeline_name": pipeline}, "checked_at", limit, "run_id", "task_name", "check_name")
    return rows, rows.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def quality_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("pipeline_name", "task_name", "passed").agg(F.count(F.lit(1)).alias("count"))


def sla_violations(runs: DataFrame, slas: DataFrame) -> DataFrame:
    """Runs that took longer than their pipeline may; as long is no violation. ``slas``: one row per pipeline that has a limit."""
    limits = slas.select("pipeline_name", (F.col("max_duration_minutes") * 60).alias("limit_seconds"))
    return runs.join(limits, "pipeline_name").filter(F.col("duration_seconds") > F.col("limit_seconds"))


def sla_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("pipeline_name").agg(F.count(F.lit(1)).alias("count"))


def status_rank(status: Column) -> Column:
    return F.when(status.isin("running", "started"), 0).when(status == "failed", 1).when(status == "completed", 2).otherwise(3)


def pipeline_summary(pipelines: DataFrame, runs: DataFrame, schedules: DataFrame, n: int = 5) -> DataFrame:
    """Each pipeline with its last status, how many of its last runs there are, and its schedule; the busy and the failed first."""
    latest = latest_by(runs.select("pipeline_name", "status", "message", "updated_at"), ["pipeline_name"], "updated_at")
    counts = run_history(runs, None, n).groupBy("pipeline_name").agg(F.count(F.lit(1)).alias("runs"))
    out = pipelines.join(latest, "pipeline_name", "left").join(counts, "pipeline_name", "left").join(schedules.select("pipeline_name", "schedule"), "pipeline_name", "left")
    out = out.select(
        "pipeline_name", F.coalesce("status", F.lit("never_run")).alias("last_status"), F.coalesce("message", F.when(F.col("status").isNull(), "No runs yet")).alias("last_message"), F.col("updated_at").alias("last_updated_at"),
        F.coalesce("runs", F.lit(0)).alias("run_count"), F.col("schedule").isNotNull().alias("is_scheduled"), "schedule", F.coalesce("status", F.lit("idle")).alias("health"),
    )
    return out.orderBy(status_rank(F.col("last_status")), F.lower("pipeline_name"))


def workspace_stats(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("total_pipelines"), F.count_if("is_scheduled").alias("scheduled_pipelines"), F.count_if(F.col("health").isin("started", "running")).alias("active_runs"),
        F.count_if(F.col("last_status") == "completed").alias("successful_pipelines"), F.count_if(F.col("last_status") == "failed").alias("failed_pipelines"),
    )


def recent_runs(runs: DataFrame, per: int = 5, n: int = 12) -> DataFrame:
    """The n newest of the last runs of every pipeline."""
    return run_history(runs, None, per).orderBy(F.desc("updated_at"), "pipeline_name", "run_id").limit(n)


def _escaped(c: str) -> Column:
    text = F.coalesce(F.col(c).cast("string"), F.lit(""))
    for plain, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


#: Counter families with their help texts and labels (label, column).
FAMILIES = {
    "dp_pipeline_runs_total": ("Total pipeline run status events per pipeline and status.", (("pipeline", "pipeline_name"), ("status", "status"))),
    "dp_quality_check_results_total": ("Total quality check executions per pipeline, task, and result.", (("pipeline", "pipeline_name"), ("task", "task_name"), ("result", "result"))),
    "dp_sla_violations_total": ("Total SLA violations recorded per pipeline.", (("pipeline", "pipeline_name"),)),
}


def metrics_text(runs: DataFrame, quality: DataFrame, sla: DataFrame) -> DataFrame:
    """Lines of the Prometheus text format, in order of (family, part, value)."""
    results = quality_counts(quality).withColumn("result", F.when(F.col("passed"), "passed").otherwise("failed"))
    out = None
    for k, ((family, (text, labels)), counts) in enumerate(zip(FAMILIES.items(), (run_counts(runs), results, sla_counts(sla)))):
        inner = F.concat_ws(",", *[F.concat(F.lit(f'{label}="'), _escaped(c), F.lit('"')) for label, c in labels])
        lines = counts.select(F.lit(k).alias("family"), F.lit(1).alias("part"), F.concat(F.lit(family + "{"), inner, F.lit("} "), F.col("count").cast("string")).alias("value"))
        head = counts.sparkSession.createDataFrame([(k, 0, f"# HELP {family} {text}"), (k, 0, f"# TYPE {family} counter"), (k, 2, "")], lines.schema)
        own = head.unionByName(lines)
        out = own if out is None else out.unionByName(own)
    return out.orderBy("family", "part", "value")


def recover_orphans(queue: DataFrame, now: Column, error: str = "Interrupted by a restart") -> DataFrame:
    """Queued and running rows as failed, with the time and the reason; ``recovered`` marks them."""
    orphan = F.col("status").isin("queued", "running")
    return queue.withColumns({"recovered": orphan, "completed_at": F.when(orphan, now).otherwise(F.col("completed_at")), "error": F.when(orphan, error).otherwise(F.col("error")), "status": F.when(orphan, "failed").otherwise(F.col("status"))})


def fold_run_state(events: DataFrame) -> DataFrame:
    """Current state of each run from its status events: when it was queued, started and completed, and its last error.

    Of events of equal time that of the greatest status is the last, then that of the greatest error, then of the greatest pipeline name; nulls are least.
    """
    at = lambda cond, f: f(F.when(cond, F.col("updated_at")))
    ended = ~F.col("status").isin("queued", "running")
    last = F.struct("updated_at", "status", "error", "pipeline_name")
    out = events.groupBy("run_id").agg(
        F.max_by("pipeline_name", last).alias("pipeline_name"), F.max_by("status", last).alias("status"), at(F.col("status") == "queued", F.min).alias("queued_at"),
        at(F.col("status") == "running", F.max).alias("started_at"), at(ended, F.max).alias("completed_at"), F.max_by(F.when(ended, F.col("error")), F.when(ended, last)).alias("error"),
    )
    return out


def audit_events(log: DataFrame, actor: str | None = None, resource: str | None = None, event_type: str | None = None, limit: int = 100) -> DataFrame:
    """Newest events that equal every given filter; ``details`` as JSON where it is valid, its text kept in any case."""
    rows = recent_rows(log, {"actor": actor, "resource": resource, "event_type": event_type}, "occurred_at", limit, "event_id")
    return rows.withColumn("details_json", F.try_parse_json("details"))


def error_summary(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Errors of the tasks of each run as one text "task: error; task: error"."""
    return errors.filter("error IS NOT NULL").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "task_name", "error"))), "; ").alias("message"))


# --- costs -----------------------------------------------------------------------------------

RATE = 0.0001


def run_cost(df: DataFrame, rate: float = RATE) -> DataFrame:
    """Compute units of each run: tasks times seconds times rate, to 6 digits; halves of the sixth, as doubles give them, go away from zero."""
    units = F.col("task_count") * F.col("duration_seconds") * F.lit(float(rate))
    # beyond 1e9 a double has no such digits to spare
    units = F.when(F.abs(units) < 1e9, F.signum(units) * F.floor(F.abs(units) * 1e6 + 0.5) / 1e6).otherwise(units)
    return df.withColumns({"estimated_cost_usd": units, "duration_seconds": F.round("duration_seconds", 3)})


def _exact(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(24,6)")).cast("double")


def cost_by_pipeline(costs: DataFrame, limit: int | None = 100) -> DataFrame:
    out = costs.groupBy("pipeline_name", "team").agg(F.count(F.lit(1)).alias("runs"), _exact("duration_seconds").alias("duration_seconds"), _exact("estimated_cost_usd").alias("cost"), F.max("recorded_at").alias("last_run"))
    out = out.withColumn("unit", F.lit("compute_units")).orderBy(F.desc("cost"), "pipeline_name", F.col("team").asc_nulls_last())
    return out if limit is None else out.limit(limit)


def cost_by_team(costs: DataFrame) -> DataFrame:
    """By team as recorded: no team and a team named "unassigned" stay two rows."""
    out = costs.groupBy("team").agg(F.count_distinct("pipeline_name").alias("pipelines"), F.count(F.lit(1)).alias("runs"), _exact("duration_seconds").alias("duration_seconds"), _exact("estimated_cost_usd").alias("cost"))
    return out.withColumn("team", F.coalesce("team", F.lit("unassigned"))).orderBy(F.desc("cost"), "team")


def cost_history(costs: DataFrame, pipeline: str, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    rows = recent_rows(costs, {"pipeline_name": pipeline}, "recorded_at", limit, "run_id")
    return rows, rows.agg(F.round(_exact("estimated_cost_usd"), 6).alias("total_cost"))


def cost_totals(costs: DataFrame) -> DataFrame:
    return costs.agg(_exact("estimated_cost_usd").alias("cost"), F.count(F.lit(1)).alias("runs"), _exact("duration_seconds").alias("duration_seconds"))


def run_share(costs: DataFrame, n: int = 10) -> DataFrame:
    """Pipelines of most runs, each with its percentage of the most."""
    top = costs.groupBy("pipeline_name").agg(F.count(F.lit(1)).alias("runs")).orderBy(F.desc("runs"), "pipeline_name").limit(n)
    return top.withColumn("percent", 100 * F.col("runs") / F.max("runs").over(Window.partitionBy(F.lit(1))))
