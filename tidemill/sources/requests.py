"""Requests of a table, each answered once, over as many rounds as its failures need."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .external import fetch
from .files import exists

#: What is stored of requests and answers.
REQUESTS = "request string, url string, params map<string,string>, headers map<string,string>"
ANSWERS = "request string, url string, status int, body string, error string"
_ROUND = f"{ANSWERS}, round int"


class _Range(InputPartition):
    def __init__(self, path: str):
        self.path = path


class HttpRequests(DataSource):
    """``format("http_requests")``: answers to the requests of a stored Parquet table (option ``path``), which has :data:`REQUESTS` as columns.

    A partition is a range of the table, a file of it; the driver sees names of files alone. One try each; options: ``timeout``.
    """

    @classmethod
    def name(cls):
        return "http_requests"

    def schema(self):
        return ANSWERS

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.timeout = options["path"], float(options.get("timeout", 30))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), self.path)

    def partitions(self):
        from pyarrow import fs

        files, root = self._files()
        return [_Range(f.path) for f in files.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-")]

    def read(self, part):
        import pyarrow.parquet as pq

        files, _ = self._files()
        with files.open_input_file(part.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(100):
                for r in batch.to_pylist():
                    asked = {"url": r["url"], "params": dict(r["params"] or {}), "headers": dict(r["headers"] or {})}
                    yield (r["request"], *fetch(asked, 1, self.timeout))


def request_table(requests: DataFrame) -> DataFrame:
    """Rows (url, and params and headers as maps if there are any) as requests, each once, with a digest of all its parts as its key."""
    none = F.lit(None).cast("map<string,string>")
    part = lambda c: F.col(c).cast("map<string,string>") if c in requests.columns else none
    rows = requests.filter("url IS NOT NULL").select("url", part("params").alias("params"), part("headers").alias("headers"))
    text = F.to_json(F.struct("url", *[F.array_sort(F.map_entries(c)).alias(c) for c in ("params", "headers")]))
    return rows.withColumn("request", F.sha2(text, 256)).dropDuplicates(["request"]).select("request", "url", "params", "headers")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """request, url, status, body, error and attempts of all requests asked so far, by their last answers."""
    rows = spark.read.schema(_ROUND).parquet(f"{folder}/answers")
    last = rows.groupBy("request").agg(F.max_by(F.struct("url", "status", "body", "error"), "round").alias("last"), F.count(F.lit(1)).cast("int").alias("attempts"))
    return last.select("request", "last.*", "attempts")


def fetch_all(spark: SparkSession, requests: DataFrame, folder: str, tries: int = 3, per_task: int = 1000, timeout: float = 30, wait: float = 1) -> DataFrame:
    """Answers to a table of requests (:func:`request_table`), failures too, as rows; see :func:`answers`.

    The requests of a round are stored in files of at most ``per_task`` and fetched by a task a file; their answers are stored by round. A next round, after
    ``wait`` seconds, twice as long each time, has only requests that failed for the server's or the network's sake, ``tries`` at most. The stored answers are the state of every request: called
    again after a failure, with the same folder, what was answered is not asked again.
    """
    spark.dataSource.register(HttpRequests)
    table = request_table(requests)
    for attempt in range(tries):
        number = 0
        while exists(spark, f"{folder}/answers/round={number}/_SUCCESS"):
            number += 1
        pending = table
        if number:
            tried = answers(spark, folder)
            settled = tried.filter(f"error IS NULL OR status BETWEEN 400 AND 499 OR attempts >= {tries}")
            pending = table.join(settled, "request", "left_anti")
        asked = f"{folder}/requests/{number}"
        pending.write.mode("overwrite").option("maxRecordsPerFile", per_task).parquet(asked)
        if spark.read.schema(REQUESTS).parquet(asked).isEmpty():
            break
        if attempt:
            time.sleep(wait * 2 ** (attempt - 1))
        spark.read.format("http_requests").options(path=asked, timeout=str(timeout)).load().write.mode("overwrite").parquet(f"{folder}/answers/round={number}")
    return answers(spark, folder) if exists(spark, f"{folder}/answers") else spark.createDataFrame([], f"{ANSWERS}, attempts int")
