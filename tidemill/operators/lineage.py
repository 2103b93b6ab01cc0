"""Lineage from SQL and declarations, lineage graphs, and the asset catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of tables in SQL text.
_NAME = r'([`"\[]?[\w.]+[`"\]]?)'
INSERTS = rf"(?i)\bINSERT\s+INTO\s+{_NAME}"
CREATES = rf"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s+AS\b"
READS = rf"(?i)\b(?:FROM|JOIN)\s+{_NAME}"
LOCAL = "duckdb://local/"


def sql_lineage(queries: DataFrame, sql: str, *keys: str) -> DataFrame:
    """keys, direction and asset_uri of every table a query text writes to or reads from, each once."""
    plain = F.regexp_replace(F.regexp_replace(F.col(sql), r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    found = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all("_sql", F.lit(pattern), 1), lambda x: F.translate(x, '`"[]', "")))
    rows = queries.select(*keys, plain.alias("_sql"))
    rows = rows.withColumn("_w", F.array_distinct(F.concat(found(INSERTS), found(CREATES)))).withColumn("_r", F.array_except(found(READS), "_w"))
    tagged = lambda c, d: F.transform(c, lambda x: F.struct(F.lit(d).alias("direction"), F.concat(F.lit(LOCAL), x).alias("asset_uri")))
    return rows.select(*keys, F.inline(F.concat(tagged("_w", "writes_to"), tagged("_r", "reads_from"))))


def declared_lineage(tasks: DataFrame) -> DataFrame:
    """Rows of the arrays ``reads_from`` and ``writes_to`` of tasks; other columns stay."""
    others = [c for c in tasks.columns if c not in ("reads_from", "writes_to")]
    both = F.array(*[F.struct(F.lit(d).alias("direction"), F.coalesce(d, F.array().cast("array<string>")).alias("uris")) for d in ("reads_from", "writes_to")])
    return tasks.select(*others, F.inline(both)).select(*others, "direction", F.explode("uris").alias("asset_uri"))


def lineage_edges(records: DataFrame) -> DataFrame:
    """Each edge once, with when it was last seen, newest first."""
    return records.groupBy("pipeline_name", "task_name", "direction", "asset_uri").agg(F.max("recorded_at").alias("last_seen")).orderBy(F.col("last_seen").desc_nulls_last(), "pipeline_name", "task_name", "direction", "asset_uri")


def _task_id() -> Column:
    return F.concat_ws("/", "pipeline_name", "task_name")


def lineage_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type, label) and edges (source, target, direction): assets into tasks that read them, tasks into assets they write."""
    flat = records.select("direction", "asset_uri", "task_name", _task_id().alias("task")).distinct()
    ends = F.array(F.struct(F.col("asset_uri").alias("id"), F.lit("asset").alias("type"), F.col("asset_uri").alias("label")), F.struct(F.col("task").alias("id"), F.lit("task").alias("type"), F.col("task_name").alias("label")))
    nodes = flat.select(F.inline(ends)).distinct()
    reads = F.col("direction") == "reads_from"
    edges = flat.select(F.when(reads, F.col("asset_uri")).otherwise(F.col("task")).alias("source"), F.when(reads, F.col("task")).otherwise(F.col("asset_uri")).alias("target"), "direction").distinct()
    return nodes, edges


def asset_lineage(records: DataFrame, uri: str | None = None) -> DataFrame:
    """asset_uri, role (upstream: it writes the asset; downstream: it reads it), pipeline and task."""
    own = records if uri is None else records.filter(F.col("asset_uri") == uri)
    return own.select("asset_uri", F.when(F.col("direction") == "writes_to", "upstream").otherwise("downstream").alias("role"), "pipeline_name", "task_name").distinct()


def search_lineage(records: DataFrame, text: str) -> DataFrame:
    """Records of tasks of which the pipeline, the task or any asset holds the text, whatever its case."""
    low = text.lower()
    hit = F.lower("pipeline_name").contains(low) | F.lower("task_name").contains(low) | F.lower("asset_uri").contains(low)
    tasks = records.filter(hit).select("pipeline_name", "task_name").distinct()
    return records.join(tasks, ["pipeline_name", "task_name"], "left_semi")


# --- catalog ---------------------------------------------------------------------------------

#: Labels of URI schemes.
SCHEMES = {
    "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "mysql": "MySQL", "s3": "S3", "gcs": "GCS", "duckdb": "DuckDB", "kafka": "Kafka",
    "snowflake": "Snowflake", "bigquery": "BigQuery", "file": "File", "http": "HTTP", "https": "HTTP", "spark": "Spark",
}


def asset_type(uri: Column | str) -> Column:
    uri = F.col(uri) if isinstance(uri, str) else uri
    scheme = F.lower(F.split_part(uri, F.lit("://"), F.lit(1)))
    labels = F.create_map(*[F.lit(x) for kv in SCHEMES.items() for x in kv])
    capital = F.concat(F.upper(F.substring(scheme, 1, 1)), F.substring(scheme, 2, 1_000_000))
    return F.when(uri.contains("://"), F.coalesce(F.try_element_at(labels, scheme), capital)).otherwise("Unknown")


def like_text(text: str) -> str:
    """A LIKE pattern for texts that hold ``text``, its wildcards escaped."""
    for c in "\\%_":
        text = text.replace(c, "\\" + c)
    return f"%{text}%"


def catalog_assets(records: DataFrame, q: str | None = None, limit: int | None = 100) -> DataFrame:
    """Assets with pipelines, reads, writes and last record; most used first."""
    own = records.filter(F.col("asset_uri").ilike(like_text(q))) if q else records
    out = own.groupBy("asset_uri").agg(F.count_distinct("pipeline_name").alias("pipeline_count"), F.count_if(F.col("direction") == "reads_from").alias("read_count"), F.count_if(F.col("direction") == "writes_to").alias("write_count"), F.max("recorded_at").alias("last_seen"))
    out = out.withColumn("asset_type", asset_type("asset_uri")).orderBy(F.desc("pipeline_count"), F.col("last_seen").desc_nulls_last(), "asset_uri")
    return out if limit is None else out.limit(limit)


def asset_detail(records: DataFrame, uri: str) -> DataFrame:
    """Pipelines and tasks of one asset with their last record, and how many pipelines there are; none if unknown."""
    by = records.filter(F.col("asset_uri") == uri).groupBy("asset_uri", "pipeline_name", "task_name", "direction").agg(F.max("recorded_at").alias("last_seen"))
    return by.join(by.groupBy("asset_uri").agg(F.count_distinct("pipeline_name").alias("pipeline_count")), "asset_uri")


def pipeline_catalog(records: DataFrame) -> DataFrame:
    reads = F.col("direction") == "reads_from"
    return records.groupBy("pipeline_name").agg(F.count_distinct("asset_uri").alias("asset_count"), F.count_distinct(F.when(reads, F.col("asset_uri"))).alias("inputs"), F.count_distinct(F.when(~reads, F.col("asset_uri"))).alias("outputs"), F.max("recorded_at").alias("last_run"))


def catalog_totals(records: DataFrame) -> DataFrame:
    return catalog_assets(records, limit=None).agg(F.count(F.lit(1)).alias("assets"), F.sum("pipeline_count").alias("pipeline_links"))
