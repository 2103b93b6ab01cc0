"""Pipeline definitions and task graphs as tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.files import decode_files
from tidemill.sources.scratch import drop, stored

#: Keys a schedule may have.
SCHEDULE_KEYS = ("minute", "hour", "day", "month", "day_of_week")

_INVENTORY = "path string, pipeline_name string, team string, tags array<string>, schedule map<string,string>, tasks array<struct<name:string,id:string,plugin:string,depends_on:array<string>>>, error_type string, error string"


def pipeline_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A row per definition file: its parsed fields, or the type and text of its error. YAML is decoded in the tasks."""

    def decode(batches):
        import pandas as pd
        import yaml

        def texts(x):
            return [str(v) for v in x] if isinstance(x, list) else []

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    d = yaml.safe_load(content)
                    if not isinstance(d, dict) or not d.get("pipeline_name") or not isinstance(d.get("tasks"), list) or not d["tasks"]:
                        raise ValueError("a definition needs pipeline_name and tasks")
                    tasks = [{"name": str(t["name"]), "id": None if t.get("id") is None else str(t["id"]), "plugin": t.get("plugin"), "depends_on": texts(t.get("depends_on"))} for t in d["tasks"]]
                    schedule = {str(k): None if v is None else str(v) for k, v in (d.get("schedule") or {}).items()}
                    rows.append((path, str(d["pipeline_name"]), d.get("team"), texts(d.get("tags")), schedule, tasks, None, None))
                except (yaml.YAMLError, ValueError, KeyError, TypeError, AttributeError) as e:
                    rows.append((path, None, None, None, None, None, type(e).__name__, str(e)))
            yield pd.DataFrame(rows, columns=["path", "pipeline_name", "team", "tags", "schedule", "tasks", "error_type", "error"])

    return decode_files(spark, path, decode, _INVENTORY)


def template_metadata(tasks: DataFrame) -> DataFrame:
    """task_count, plugins and tags of each pipeline. ``tasks``: pipeline, name, plugin, tags."""
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags"))))
    return tasks.groupBy("pipeline").agg(F.count(F.lit(1)).alias("task_count"), F.sort_array(F.collect_set("plugin")).alias("plugins"), tags.alias("tags"))


def task_names(tasks: DataFrame) -> DataFrame:
    """pipeline, alias and name: a task is known by its name, and by its id if it has one."""
    both = F.array_distinct(F.array_compact(F.array("name", "id")))
    return tasks.select("pipeline", F.explode(both).alias("alias"), "name").distinct()


def definition_errors(tasks: DataFrame, schedules: DataFrame | None = None) -> DataFrame:
    """pipeline, error and detail of duplicate names, unknown or own dependencies, and unsupported schedule keys."""
    duplicate = tasks.groupBy("pipeline", "name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("pipeline", F.lit("duplicate_name").alias("error"), F.col("name").alias("detail"))
    needs = tasks.select("pipeline", "name", F.coalesce("id", "name").alias("own"), F.explode("depends_on").alias("alias"))
    unknown = needs.join(task_names(tasks), ["pipeline", "alias"], "left_anti").select("pipeline", F.lit("unknown_dependency").alias("error"), F.concat_ws(" -> ", "name", "alias").alias("detail"))
    itself = needs.filter("own = alias").select("pipeline", F.lit("self_dependency").alias("error"), F.col("name").alias("detail"))
    out = duplicate.unionByName(unknown).unionByName(itself)
    if schedules is not None:
        odd = F.array_except(F.map_keys("schedule"), F.array(*map(F.lit, SCHEDULE_KEYS)))
        out = out.unionByName(schedules.select("pipeline", F.lit("unsupported_schedule_key").alias("error"), F.explode(odd).alias("detail")))
    return out


def task_edges(tasks: DataFrame) -> DataFrame:
    """pipeline, source and target of every dependency, by names whether it was given by name or id."""
    needs = tasks.select("pipeline", F.col("name").alias("target"), F.explode("depends_on").alias("alias"))
    return needs.join(task_names(tasks), ["pipeline", "alias"]).select("pipeline", F.col("name").alias("source"), "target").distinct()


#: Graphs of at most so many edges are levelled by the task that holds them, several at once. Growth of paths over edges beyond which doubling stops.
SMALL, WIDEST = 10_000, 16


def topo_levels(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """pipeline, task, level and cyclic for edges (pipeline, task, depends_on) of any number of graphs at once.

    A level is the longest path from a task without dependencies; tasks on or behind a cycle get none. Null tasks are left out, tasks with null
    dependencies stay. Graphs of at most ``small`` edges are brought together by one shuffle and levelled within tasks; larger ones, of any size, by doubling
    (:func:`doubled_levels`).
    """
    counts = edges.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small)
    large = [r["pipeline"] for r in counts.limit(1).collect()]
    if not large:
        return levels_within(edges)
    sizes = stored(counts.select(F.col("pipeline").alias("key"), F.lit(True).alias("big")), "large-graphs")
    marked = edges.join(sizes, F.col("pipeline").eqNullSafe(F.col("key")), "left")
    rest = marked.filter("big IS NULL").select("pipeline", "task", "depends_on")
    return levels_within(rest).unionByName(doubled_levels(marked.filter("big").select("pipeline", "task", "depends_on")))


def frontier_levels(source: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """Levels of n tasks by edges between their numbers; -1 on or behind a cycle."""
    need, level = np.bincount(target, minlength=n), np.full(n, -1)
    order = np.argsort(source, kind="stable")
    target, starts = target[order], np.searchsorted(source[order], np.arange(n + 1))
    now, at = np.flatnonzero(need == 0), 0
    while len(now):
        level[now] = at
        out = np.diff(starts)[now]
        told = target[np.repeat(starts[now] - np.cumsum(out) + out, out) + np.arange(out.sum())]
        np.subtract.at(need, told, 1)
        told = np.unique(told)
        now, at = told[need[told] == 0], at + 1
    return level


def levels_within(edges: DataFrame) -> DataFrame:
    """Levels of graphs that each fit a task: those of a task are levelled together, some rows at a time."""
    types = dict(edges.dtypes)

    def levelled(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        n, graphs = rows.num_rows, rows.column("pipeline").combine_chunks().dictionary_encode(null_encoding="encode")
        tasks = pa.concat_arrays([rows.column(c).combine_chunks() for c in ("task", "depends_on")]).dictionary_encode()
        number, wide = tasks.indices.fill_null(-1).to_numpy().astype(np.int64), len(tasks.dictionary)
        graph = np.tile(graphs.indices.to_numpy().astype(np.int64), 2)
        known = number >= 0
        nodes, place = np.unique((graph * wide + number)[known], return_inverse=True)
        at = np.full(2 * n, -1)
        at[known] = place
        both = (at[:n] >= 0) & (at[n:] >= 0)
        links = np.unique(at[n:][both] * np.int64(len(nodes)) + at[:n][both])
        level = frontier_levels(links // max(1, len(nodes)), links % max(1, len(nodes)), len(nodes))
        take = lambda values, index: values.take(pa.array(index))
        return pa.RecordBatch.from_arrays([take(graphs.dictionary, nodes // max(1, wide)), take(tasks.dictionary, nodes % max(1, wide)), pa.array(level, mask=level < 0), pa.array(level < 0)], ["pipeline", "task", "level", "cyclic"])

    def run(batches):
        held = None
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            graph = held.column("pipeline")
            last = graph[held.num_rows - 1] if held.num_rows else None
            whole = held.num_rows
            # the last graph of a batch may go on in the next one
            while whole and graph[whole - 1].as_py() == last.as_py():
                whole -= 1
            if whole:
                yield levelled(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield levelled(held)

    rows = edges.select("pipeline", "task", F.col("depends_on").cast(types["task"]).alias("depends_on")).repartition("pipeline").sortWithinPartitions("pipeline")
    return rows.mapInArrow(run, f"pipeline {types['pipeline']}, task {types['task']}, level long, cyclic boolean")


def doubled_levels(edges: DataFrame) -> DataFrame:
    """Levels by doubling: after round k, a task has its level if that is under 2^k, or else the tasks from which 2^k edges lead to it.

    A round joins these pairs with what is known of their beginnings: a pair met by pairs gives pairs twice as long; a task whose
    beginnings all have levels gets 2^k plus the greatest of them. So rounds are the logarithm of the depth. Tasks that still have pairs when 2^k reaches the number
    of tasks of the largest graph are on or behind a cycle. Where pairs outgrow the edges :data:`WIDEST` times, which wide and shallow graphs do, levels are peeled
    off one by one instead (:func:`peeled_levels`).
    """
    known = stored(edges.select("pipeline", "task", "depends_on").distinct(), "known")
    links = known.filter("task IS NOT NULL AND depends_on IS NOT NULL")
    nodes = known.select("pipeline", F.explode(F.array("task", "depends_on")).alias("task")).filter("task IS NOT NULL").distinct()
    roots = nodes.join(links.select("pipeline", "task").distinct(), ["pipeline", "task"], "left_anti").withColumn("level", F.lit(0).cast("long"))
    done = [stored(roots, "levels")]
    pairs = stored(links.select("pipeline", "task", F.col("depends_on").alias("start")), "paths")
    n_edges, most = pairs.count(), nodes.groupBy("pipeline").count().agg(F.max("count")).first()[0] or 0
    step, n_pairs = 1, n_edges
    while n_pairs and step < most:
        # how many pairs the next ones are made of, by the numbers of pairs that end and begin at each task
        ends, begins = (pairs.groupBy("pipeline", F.col(c).alias("at")).agg(F.count(F.lit(1)).cast("double").alias(c)) for c in ("task", "start"))
        if (ends.join(begins, ["pipeline", "at"]).agg(F.sum(F.col("task") * F.col("start"))).first()[0] or 0) > WIDEST * n_edges:
            return peeled_levels(known)
        begun = reduce(DataFrame.unionByName, done).select("pipeline", F.col("task").alias("start"), "level", F.lit(None).cast(dict(pairs.dtypes)["start"]).alias("before"))
        begun = begun.unionByName(pairs.select("pipeline", F.col("task").alias("start"), F.lit(None).cast("long").alias("level"), F.col("start").alias("before")))
        met = stored(pairs.join(begun, ["pipeline", "start"]).groupBy("pipeline", "task", "before").agg((F.max("level") + step).alias("level")), "paths")
        drop(pairs)
        pairs = met.filter("before IS NOT NULL").select("pipeline", "task", F.col("before").alias("start"))
        pairs.stored_path = met.stored_path
        ended = met.groupBy("pipeline", "task").agg(F.max("level").alias("level"), F.count("before").alias("n")).filter("n = 0").drop("n")
        done.append(stored(ended, "levels"))
        step, n_pairs = 2 * step, pairs.count()
    return reduce(DataFrame.unionByName, done).withColumn("cyclic", F.lit(False)).unionByName(pairs.select("pipeline", "task", F.lit(None).cast("long").alias("level"), F.lit(True).alias("cyclic")).distinct())


def peeled_levels(edges: DataFrame, rounds_per_write: int = 6) -> DataFrame:
    """Levels peeled off one by one: in a round the tasks of the last level tell those that need them, and what then needs nothing more is the next.

    Rounds are as many as the deepest graph has levels, whatever cycles there are: when some rounds peel nothing, the tasks that stay are on or behind a cycle.
    A round is one join and one aggregation, both by task, so it shuffles once; some rounds are planned together before levels are written.
    """
    known = edges.select("pipeline", "task", "depends_on").distinct()
    links = stored(known.filter("task IS NOT NULL AND depends_on IS NOT NULL").select("pipeline", F.col("depends_on").alias("task"), F.col("task").alias("next")), "links")
    each = known.select("pipeline", F.inline(F.array(F.struct("task", F.col("depends_on").isNotNull().cast("long").alias("need")), F.struct(F.col("depends_on").alias("task"), F.lit(0).cast("long").alias("need")))))
    first = each.filter("task IS NOT NULL").groupBy("pipeline", "task").agg(F.sum("need").alias("need"))
    nodes = stored(first.withColumn("level", F.when(F.col("need") == 0, F.lit(0).cast("long"))), "levels")
    level, left = 0, nodes.filter("level IS NULL").count()
    while left:
        before, held = nodes, left
        for _ in range(rounds_per_write):
            own = F.struct("task", "need", "level", F.lit(0).cast("long").alias("done"))
            told = F.struct(F.col("next").alias("task"), F.lit(None).cast("long").alias("need"), F.lit(None).cast("long").alias("level"), (F.col("level") == level).cast("long").alias("done"))
            rows = nodes.join(links, ["pipeline", "task"], "left").select("pipeline", F.inline(F.array(own, told))).filter("task IS NOT NULL")
            sums = rows.groupBy("pipeline", "task").agg((F.max("need") - F.coalesce(F.sum("done"), F.lit(0))).alias("need"), F.max("level").alias("level"))
            level += 1
            nodes = sums.withColumn("level", F.coalesce("level", F.when(F.col("need") == 0, F.lit(level).cast("long"))))
        nodes = stored(nodes, "levels")
        drop(before)
        left = nodes.filter("level IS NULL").count()
        if left == held:
            break
    return nodes.select("pipeline", "task", "level", F.col("level").isNull().alias("cyclic"))


#: Operations this library covers, by module.
OPERATIONS = {
    "tidemill.operators.table": ("profile", "query", "aggregate", "transform", "load", "dataframe_transform", "sql_query"),
    "tidemill.operators.checks": ("validate", "quality", "metrics"),
    "tidemill.sources.files": ("load", "read", "create", "append", "merge", "list", "export"),
    "tidemill.sources.external": ("query", "load", "extract", "bulk_insert", "export", "publish", "consume", "GET"),
    "tidemill.functions.registry": ("execute_code",),
}


def operators_for(spark: SparkSession, operation: str | DataFrame) -> DataFrame:
    """Modules that support an operation; or, for a table with a column ``operation``, its rows with the modules that support each (none: empty)."""
    rows = spark.createDataFrame([(m, list(ops)) for m, ops in OPERATIONS.items()], "module string, operations array<string>")
    if not isinstance(operation, DataFrame):
        return rows.filter(F.array_contains("operations", operation)).orderBy("module")
    known = [F.when(F.col("operation").isin(*ops), F.lit(m)) for m, ops in sorted(OPERATIONS.items())]
    return operation.withColumn("modules", F.array_compact(F.array(*known)))
