"""History tables to which a batch is added once, however often it is sent."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .files import HISTORY

#: Folder of a table's markers and staged batches; readers pass over names that begin so. Markers of so many batches are kept for each query.
BATCHES, KEPT = "_batches", 10


class _Folder:
    """The file system that holds a path, by Spark's own means."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def exists(self, name: str) -> bool:
        return self.files.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.files.listStatus(self.path(name))] if self.exists(name) else []

    def parts(self, name: str) -> list[str]:
        """Data files below a folder, by their paths within it."""
        base, found, out = self.files.makeQualified(self.path(name)).toString() + "/", self.files.listFiles(self.path(name), True), []
        while found.hasNext():
            out.append(found.next().getPath().toString().removeprefix(base))
        return sorted(p for p in out if p.rsplit("/", 1)[-1].startswith("part-"))

    def write(self, name: str, text: str) -> None:
        """A file that is there whole or not at all."""
        out = self.files.create(self.path(f"{name}.tmp"), True)
        out.writeBytes(text)
        out.close()
        self.move(f"{name}.tmp", name)

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def move(self, name: str, to: str) -> None:
        self.files.mkdirs(self.path(to).getParent())
        if not self.files.rename(self.path(name), self.path(to)):
            raise OSError(f"{self.path(name).toString()} could not be moved to {to}")

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), True)


def landed(spark: SparkSession, folder: str, table: str, query: str, batch: int) -> bool:
    """Whether a batch of a query, or one after it, is in the table."""
    root = _Folder(spark, f"{folder}/{table}")
    return any(n.isdigit() and int(n) >= batch and root.exists(f"{BATCHES}/{query}/{n}/landed") for n in root.names(f"{BATCHES}/{query}"))


def append_once(df: DataFrame, folder: str, table: str, query: str, batch: int) -> bool:
    """Append a batch of a query to a history table, partitioned by date; nothing if it is there already. Returns whether it was added.

    The rows are written beside the table first. Then a list says which files go where, under names of the query and the batch; they
    are moved, and a marker says that the batch has landed. A batch sent again after a failure is staged anew before its list is written, and after that its
    moves are completed from the list, so it lands once and whole. Batches of a query have rising numbers, as those of a stream have: a batch
    before one that has landed is taken as there. Readers may meet a batch of which some files are not moved yet.
    """
    spark, root = df.sparkSession, _Folder(df.sparkSession, f"{folder}/{table}")
    if not re.fullmatch(r"[\w-]+", query):
        raise ValueError("a query's name is made of letters, digits, _ and -")
    if landed(spark, folder, table, query, batch):
        return False
    own = f"{BATCHES}/{query}/{batch}"
    if not root.exists(f"{own}/moves"):
        df.withColumn("date", F.to_date(HISTORY[table])).write.mode("overwrite").partitionBy("date").parquet(root.path(f"{own}/staged").toString())
        moves = [[p, f"{p.rsplit('/', 1)[0]}/part-{query}-{batch}-{k:05d}.parquet"] for k, p in enumerate(root.parts(f"{own}/staged"))]
        root.write(f"{own}/moves", json.dumps(moves))
    for staged, final in json.loads(root.read(f"{own}/moves")):
        if root.exists(f"{own}/staged/{staged}"):
            root.move(f"{own}/staged/{staged}", final)
        elif not root.exists(final):
            raise OSError(f"a file of batch {batch} of {query} is lost: {final}")
    root.write(f"{own}/landed", "")
    root.delete(f"{own}/staged")
    for old in root.names(f"{BATCHES}/{query}"):
        if old.isdigit() and int(old) <= batch - KEPT:
            root.delete(f"{BATCHES}/{query}/{old}")
    return True


def query_of(checkpoint: str) -> str:
    """The name of a stream that keeps its position in ``checkpoint``, the same after each start."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def history_stream(rows: DataFrame, folder: str, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append every batch of a stream to a history table once, also if it is sent again after a failure; ``every=None`` handles what is there and ends."""

    def add(batch: DataFrame, number: int) -> None:
        append_once(batch, folder, table, query_of(checkpoint), number)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
