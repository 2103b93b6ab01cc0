"""Token-ID output: ORC stripes of integer run-length encoded ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir, text_of
from .tokens import Encoder, crc32_of, in_chunks, lists

_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, vocabulary: str, kind: str = "word", end: int = 1, partitions: int | None = None, stripe_mb: int = 64, row_index: int = 1000) -> None:
    """Encode every whole text and write ORC files in ascending document id.

    Documents are dealt into ranges of ids before they are encoded, so ids never move
    between executors; each range becomes one file, whose rows are in order. ORC stores
    the ids by integer run-length encoding in stripes, with a row index every
    ``row_index`` documents and a Bloom filter on ``doc_id``. ``local_start`` counts ids
    before the document within its file; ``part`` numbers the files in id order.

    Null text: encoded as empty (the end id alone). Null ids sort first. Rows with equal
    ids are all kept, in order of their texts. An empty table gives an empty folder.
    Columns other than ``doc_id`` and ``text`` are ignored.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    dealt = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")

    def encode(batches):
        encoder, before = Encoder.get(vocabulary, kind), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts):
                ids, n = encoder.encode(texts[a:b], end)
                ends = np.cumsum(n)
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(before + ends - n), pa.array(n), lists(ids, ends)]
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "local_start", "n_tokens", "ids"])

    (
        dealt.sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, _SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", row_index)
        .option("orc.stripe.size", stripe_mb << 20)
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder of token files: doc_id, start, n_tokens, ids.

    Stripes are read in parallel; a filter on ``doc_id`` prunes files, stripes and row
    groups. ``start`` adds the ids of earlier files: one number a file, summed from the
    count columns alone and sent to all tasks (its size is the number of files).
    """
    rows = spark.read.schema(_SCHEMA).orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(files), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by their unsigned crc32 as little-endian 32-bit integers."""

    def digest(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("ids")
            ends = np.asarray(ids.offsets)[1:] - np.asarray(ids.offsets)[0]
            crc = pa.array(crc32_of(ids.flatten().to_numpy(), ends))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_dir(spark, "token-orc")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return with_crc32(read_token_files(spark, path))
