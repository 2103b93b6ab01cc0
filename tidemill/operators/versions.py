"""Version history of named contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hashed(versions: DataFrame) -> DataFrame:
    return versions.withColumn("version_hash", F.sha2("content", 256))


def dedupe_versions(versions: DataFrame, order: str = "saved_seq") -> DataFrame:
    """The first version of each content of a pipeline, by partial minima: contents are not sorted."""
    rows = hashed(versions)
    best = rows.groupBy("pipeline_name", "version_hash").agg(F.min_by(F.struct(*versions.columns), F.struct(order, "version_id")).alias("_row"))
    return best.select("_row.*", "version_hash")


def new_versions(existing: DataFrame, incoming: DataFrame, order: str = "saved_seq") -> DataFrame:
    """First versions of contents that their pipeline does not have yet."""
    return dedupe_versions(incoming, order).join(hashed(existing).select("pipeline_name", "version_hash"), ["pipeline_name", "version_hash"], "left_anti")


def list_versions(versions: DataFrame, pipeline: str, limit: int = 20, order: str = "saved_seq") -> DataFrame:
    """Newest versions of a pipeline, without contents."""
    return versions.filter(F.col("pipeline_name") == pipeline).drop("content").orderBy(F.desc(order), F.desc("version_id")).limit(limit)


def version_content(versions: DataFrame, pipeline: str, version_id) -> DataFrame:
    return versions.filter((F.col("pipeline_name") == pipeline) & (F.col("version_id") == version_id)).select("version_id", "content")


def version_diff(versions: DataFrame, order: str = "saved_seq", with_lines: bool = False) -> DataFrame:
    """Lines added and removed between each version and the one before it in its pipeline, as multisets.

    Every line counts +1 for its own version and -1 for the next, so one aggregation by (version, line) gives
    both sides. Only numbers of versions are sorted. Versions with the same lines have zeros; the first has no row.
    """
    own = Window.partitionBy("pipeline_name").orderBy(order, "version_id")
    ids = versions.select("pipeline_name", "version_id", F.lag("version_id").over(own).alias("previous"), F.lead("version_id").over(own).alias("next"))
    lines = versions.select("pipeline_name", "version_id", F.explode(F.split("content", "\n")).alias("line"))
    uses = F.array(F.struct(F.col("version_id").alias("version"), F.when(F.col("previous").isNotNull(), 1).alias("n")), F.struct(F.col("next").alias("version"), F.when(F.col("next").isNotNull(), -1).alias("n")))
    sides = lines.join(ids, ["pipeline_name", "version_id"]).select("pipeline_name", "line", F.inline(uses)).filter("n IS NOT NULL")
    net = sides.groupBy("pipeline_name", "version", "line").agg(F.sum("n").alias("n"))
    found = [F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed")]
    if with_lines:
        found += [F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.col("line")))).alias("added_lines"), F.sort_array(F.collect_list(F.when(F.col("n") < 0, F.col("line")))).alias("removed_lines")]
    diffs = net.groupBy("pipeline_name", F.col("version").alias("version_id")).agg(*found)
    return ids.filter("previous IS NOT NULL").select("pipeline_name", "version_id", "previous").join(diffs, ["pipeline_name", "version_id"])
