"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: How stored tables are written. Shuffle files go with the query that made them, not when the driver next collects garbage; batches
#: for Python are small, so that long rows do not add up in a worker.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

#: Paths made and not deleted yet.
_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session without one gets a temporary folder; on a cluster it has to be set."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends at the latest."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_made.items()):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _made.pop(path, None)
    with contextlib.suppress(Exception):  # the JVM may be gone
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings that hold for queries run inside; the session's own return afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table and read it back, so that later plans start from it and need nothing before it."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    with settings(spark, _WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads: call it once what was made of them is written itself."""
    for t in tables:
        _delete(t.sparkSession, t.stored_path)
