"""Structured Streaming forms of arrivals, completions, counters, service levels and quality gates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators.checks import quality_gate
from tidemill.operators.runs import sla_violations
from tidemill.sources.external import kafka_decode
from tidemill.sources.history import append_once, landed, query_of
from tidemill.sources.scratch import scratch_dir
from tidemill.sources.watch import FileChanges, added_lines


def listed(path: str) -> str:
    """A pattern that matches just this path: file streams take a single file only by a pattern."""
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def table_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, per_trigger: int | None = None) -> DataFrame:
    """Files of a folder (or one file) as a stream."""
    schema = schema if schema is not None else spark.read.format(fmt).load(path).schema
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(listed(path))


def file_arrivals(spark: SparkSession, folder: str, schema, fn: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "parquet", since=None, every: str | None = "30 seconds") -> StreamingQuery:
    """Call ``fn(rows, batch)`` for new files of a folder. Files modified before ``since`` do not fire; ``every=None`` handles what is there and ends."""
    rows = spark.readStream.format(fmt).schema(schema).load(listed(folder))
    if since is not None:
        rows = rows.filter(F.col("_metadata.file_modification_time") >= F.lit(since))

    def handle(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            fn(batch, number)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def file_changes(spark: SparkSession, folder: str, pattern: str = "*", existing: bool = False, recursive: bool = False, settle: float = 1) -> DataFrame:
    """path, size and modified of files that are new or were changed in place. Files there at the first start do not fire unless ``existing``.

    The position is a time, whatever the number of files; tasks list the folders. See :class:`FileChanges`.
    """
    spark.dataSource.register(FileChanges)
    flags = {"existing": str(existing).lower(), "recursive": str(recursive).lower(), "settle": str(settle)}
    return spark.readStream.format("file_changes").options(path=folder, pattern=pattern, **flags).load()


def completion_fires(runs: DataFrame, registrations: DataFrame, within: str | None = None, time: str = "updated_at") -> DataFrame:
    """Each successful run with every pipeline registered on it (pipeline_name upstream, downstream).

    ``within``: a run fires once, however often its completion arrives in that span of time: later ones are dropped by keyed state, which
    goes when the span has passed. Rows later than that are dropped too.
    """
    completed = runs.filter("status = 'completed'")
    if within is not None:
        timed = completed.withColumn(time, F.col(time).cast("timestamp"))
        completed = timed.withWatermark(time, within).dropDuplicatesWithinWatermark(["pipeline_name", "run_id"])
    return completed.join(registrations, "pipeline_name")


def tail_lines(spark: SparkSession, folder: str, pattern: str = "*", settle: float = 1) -> DataFrame:
    """New lines that are not blank, stripped, with their file's name as run_id: those of new files and those added to known ones.

    A line comes once it has ended. Changed files come from :func:`file_changes`; how far each was read is keyed state, so a batch reads only
    what was added, and neither position nor driver grows with the files. If a batch fails after its lines are written and a file grows before it is sent again, that file's lines may come twice.
    """
    rows = added_lines(file_changes(spark, folder, pattern, True, False, settle), folder)
    return rows.select(F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"), F.regexp_replace("file", r"\.[^.]*$", "").alias("run_id")).filter("line != ''")


def kafka_stream(spark: SparkSession, brokers: str, topic: str, schema=None, fmt: str = "kafka") -> DataFrame:
    """Messages from the earliest on; the position is kept by the query's checkpoint. ``fmt``: the connector's name."""
    raw = spark.readStream.format(fmt).option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return kafka_decode(raw, schema)


def run_counts_stream(runs: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by pipeline, status and window of their time; those later than ``late`` are dropped, so state stays bounded."""
    timed = runs.withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", late)
    out = timed.groupBy(F.window("updated_at", window).alias("w"), "pipeline_name", "status").agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.col("w.start").alias("window_start"), "pipeline_name", "status", "count")


def sla_stream(runs: DataFrame, slas: DataFrame) -> DataFrame:
    return sla_violations(runs, slas)


def quality_stream(rows: DataFrame, checks: Iterable[Mapping], folder: str, checkpoint: str, view: str = "data", pipeline: str = "", every: str | None = None) -> StreamingQuery:
    """Run a quality gate on every batch (as ``view``), and append its results to the history, once also if a batch is sent again."""
    checks, query = list(checks), query_of(checkpoint)

    def gate(batch: DataFrame, number: int) -> None:
        if landed(batch.sparkSession, folder, "quality_results", query, number):
            return
        held = batch.persist()
        try:
            append_once(quality_gate(held.sparkSession, checks, {view: held}, f"batch_{number}", pipeline, view), folder, "quality_results", query, number)
        finally:
            held.unpersist()

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(gate)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a stream over all that is there now, and read what it wrote. ``complete``: the last result."""
    spark = stream.sparkSession
    out, last = scratch_dir(spark, name), []
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch_dir(spark, f"{name}-checkpoint")).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        last.append(number)

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/{last[-1]}") if last else spark.createDataFrame([], stream.schema)
