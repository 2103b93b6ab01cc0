"""Files and named views."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.scratch import settings, stored
from tidemill.sources.watch import file_system

FORMATS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "orc": "orc", "avro": "avro", "txt": "text", "log": "text"}


def format_of(path: str, default: str = "parquet") -> str:
    """Format by the last suffix of a path, compression suffixes aside."""
    parts = [p for p in path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")[1:] if p not in ("gz", "bz2", "zst", "zstd", "snappy")]
    return FORMATS.get(parts[-1], default) if parts else default


def read_source(spark: SparkSession, path: str | list[str], fmt: str | None = None, schema=None, view: str | None = None, **options) -> DataFrame:
    """Read a path; CSV has a header, and types are inferred only if no schema is given. ``view`` also registers it."""
    fmt = fmt or format_of(path if isinstance(path, str) else path[0])
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
        if isinstance(path, str) and ".tsv" in path:
            reader = reader.option("sep", "\t")
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.options(**options).load(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def register_sources(spark: SparkSession, sources: Mapping[str, str | Mapping]) -> dict[str, DataFrame]:
    """Views by name, each a path or {path, format, schema, options}; nothing is read until used."""
    found = {}
    for name, spec in sources.items():
        spec = {"path": spec} if isinstance(spec, str) else dict(spec)
        found[name] = read_source(spark, spec["path"], spec.get("format"), spec.get("schema"), name, **spec.get("options", {}))
    return found


def bind_inputs(spark: SparkSession, inputs: Mapping[str, DataFrame]) -> None:
    """Outputs of earlier steps as views, by step name. Nothing is collected."""
    for name, df in inputs.items():
        df.createOrReplaceTempView(name)


def write_sink(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Iterable[str] = (), **options) -> int:
    """Write and return the number of rows, counted by the same job."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(fmt).mode(mode).options(**options)
    if fmt == "csv":
        writer = writer.option("header", options.get("header", True))
    if partition_by := list(partition_by):
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return seen.get["rows"]


def export_csv(df: DataFrame, path: str, order_by: Iterable[str | Column] = ()) -> int:
    """CSV files with headers, in order from file to file (a range sort; no single task writes all)."""
    order = list(order_by)
    return write_sink(df.orderBy(*order) if order else df, path, "csv")


def read_text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file: path, content and size in bytes."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_size").alias("size"))


#: Opening a small file is taken to cost as much as reading so many bytes. Spark's 4 MB put 32 files in a task; so a task gets about 1,000, or 128 MB.
_OPENING = {"spark.sql.files.openCostInBytes": str(128 << 10)}


def decode_files(spark: SparkSession, paths: str | list[str], decode: Callable, schema: str) -> DataFrame:
    """Rows that ``decode`` makes of the path and content of files, as in ``mapInPandas``; done at once and stored, so later passes decode nothing.

    For many small files: started for each 32 of them, Python takes longer to begin and end its tasks than to decode.
    """
    with settings(spark, _OPENING):
        return stored(read_text_files(spark, paths).select("path", "content").mapInPandas(decode, schema), "decoded")


def merge_files(spark: SparkSession, paths: list[str], dest: str, mode: str = "overwrite") -> DataFrame:
    """Write the lines of all files that exist to one dataset; returns path and lines of each file."""
    held = [p for p in paths if exists(spark, p)]
    if not held:
        return spark.createDataFrame([], "path string, lines long")
    rows = spark.read.option("ignoreMissingFiles", True).text(held).select("value", F.col("_metadata.file_path").alias("path"))
    rows.select("value").write.mode(mode).text(dest)
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file or folder matches a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where))


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; false if there was none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, size and modified of matching files. Contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The one string column as lines; mode ``append`` adds files."""
    df.write.mode(mode).text(path)


def write_text_files(df: DataFrame, folder: str, tasks: int | None = None) -> int:
    """Write a file per row: ``path`` below the folder, and ``content`` as it is. Returns their number; a file that is there is replaced in place.

    For many small files, where a partition for each costs a folder, a checksum file and several calls each, most of them by the driver. Rows are dealt to ``tasks``
    (default: four a core), which write through Arrow's file system. A file is moved to its place once it is whole, so a task that
    runs again writes the same, and readers meet no half of one. Of rows of equal path any one stays.
    """
    spark = df.sparkSession

    def write(batches):
        import pyarrow as pa

        (files, root), made = file_system(folder), set()
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                above, _, name = f"{root}/{path}".rpartition("/")
                if above not in made:
                    files.create_dir(above, recursive=True)
                    made.add(above)
                own = f"{above}/.{name}.{attempt}"
                with files.open_output_stream(own) as out:
                    out.write((content or "").encode())
                files.move(own, f"{above}/{name}")
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]}, pa.schema([("files", pa.int64())]))

    rows = df.select(F.col("path").cast("string"), F.col("content").cast("string"))
    dealt = rows.repartition(tasks or 4 * spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(write, "files long").agg(F.sum("files")).first()[0] or 0


#: Time column of each history table, by which it is partitioned.
HISTORY = {
    "pipeline_runs": "updated_at",
    "lineage_records": "recorded_at",
    "quality_results": "checked_at",
    "sla_violations": "violated_at",
    "metric_results": "computed_at",
    "pipeline_costs": "recorded_at",
    "pipeline_versions": "saved_at",
    "audit_log": "occurred_at",
    "git_push_log": "pushed_at",
}


def append_history(df: DataFrame, folder: str, table: str) -> int:
    """Append rows to a history table, partitioned by the date of its time column, so that reads by date prune."""
    dated = df.withColumn("date", F.to_date(HISTORY[table]))
    return write_sink(dated, f"{folder}/{table}", "parquet", "append", ["date"])


def read_history(spark: SparkSession, folder: str, table: str, schema=None) -> DataFrame:
    return read_source(spark, f"{folder}/{table}", "parquet", schema)
