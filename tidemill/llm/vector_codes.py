"""Vectors as codes of their parts, by dictionaries of the integers of each dimension."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_hot, keep

#: A component x is the integer floor(SCALE * x). Those beyond +-MOST have no code, so that no sum of squares or of components passes 64 bits.
SCALE = 1024
MOST = 1 << 24
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors that share dictionaries; vectors whose distances are added up at once, so that sums stay in the cache.
BLOCK, CHUNK = 8192, 512
_BLOCK = "ids array<long>, labels array<string>, sizes binary, values binary, codes binary"


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dictionaries of integer vectors (rows): how many different values each dimension has, all values, and codes by dimension."""
    found = [np.unique(column, return_inverse=True) for column in x.T]
    codes = np.stack([c for _, c in found]) if found else np.zeros((0, len(x)))
    return np.array([len(v) for v, _ in found], np.int32), np.concatenate([v for v, _ in found]).astype(np.int64), codes.astype(np.uint16)


def decoded(sizes: np.ndarray, values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The vectors (rows) of :func:`encode`."""
    starts = np.cumsum(sizes) - sizes
    return values[codes.astype(np.int64) + starts[:, None]].T


def nearest(sizes: np.ndarray, values: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part's codebook (ties: the lower) and its squared distance, as (parts, vectors).

    For every dimension the squared differences of its different values to all entries are tabulated once; the distances of a
    part are gathers from these tables by the vectors' codes, added up.
    """
    n_parts, _, width = books.shape
    n = codes.shape[1]
    ends = np.cumsum(sizes)
    span = int(max(np.abs(values).max(initial=0), np.abs(books).max(initial=0))) * 2
    kind = np.int32 if width * span * span < 2**31 else np.int64
    best, least = np.empty((n_parts, n), np.int64), np.empty((n_parts, n), np.int64)
    for p in range(n_parts):
        dims = range(p * width, (p + 1) * width)
        tables = [((values[ends[d] - sizes[d] : ends[d], None] - books[p, None, :, d - p * width]) ** 2).astype(kind) for d in dims]
        for a in range(0, n, CHUNK):
            own = codes[p * width : (p + 1) * width, a : a + CHUNK]
            sums = tables[0][own[0]]
            held = np.empty_like(sums)
            for table, c in zip(tables[1:], own[1:]):
                np.take(table, c, axis=0, out=held, mode="clip")
                sums += held
            at = sums.argmin(1)
            best[p, a : a + CHUNK] = at
            least[p, a : a + CHUNK] = sums[np.arange(len(at)), at]
    return best, least


def _blocks(batches):
    """Batches as one row each: ids, labels and the dictionary form of the vectors."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            vectors = part.column("v")
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            raw = [pa.array([np.ascontiguousarray(y).tobytes()], pa.binary()) for y in encode(x)]
            whole = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*whole, *raw], ["ids", "labels", "sizes", "values", "codes"])


def _opened(batch: pa.RecordBatch, k: int) -> tuple:
    raw = lambda c, kind: np.frombuffer(batch.column(c)[k].as_py(), kind)
    sizes = raw("sizes", np.int32)
    return sizes, raw("values", np.int64), raw("codes", np.uint16).reshape(len(sizes), -1)


def assign(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector of the blocks."""

    def coded(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                best, least = nearest(*_opened(batch, k), books)
                codes = pa.array([bytes(c).hex() for c in best.astype(np.uint8).T.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, codes, pa.array(least.sum(0))], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(coded, "vec_id long, label string, code string, error long")


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after a round: every entry becomes the mean, rounded down, of the parts nearest to it; unused entries stay.

    Sums are made by block and added by partial aggregation; at most a row for each entry reaches the driver.
    """
    n_parts, entries, width = books.shape
    names = ["count", *(f"s{k}" for k in range(width))]

    def sums(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                block = _opened(batch, k)
                best, x, out = nearest(*block, books)[0], decoded(*block), []
                for p in range(n_parts):
                    order = np.argsort(best[p], kind="stable")
                    used, first, count = np.unique(best[p][order], return_index=True, return_counts=True)
                    out.append(np.column_stack([p * entries + used, count, np.add.reduceat(x[order, p * width : (p + 1) * width], first, axis=0)]))
                columns = np.concatenate(out).T
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["entry", *names])

    found = blocks.mapInArrow(sums, ", ".join(f"{c} long" for c in ["entry", *names])).groupBy("entry").agg(*[F.sum(c).alias(c) for c in names]).collect()
    out = books.reshape(-1, width).copy()
    for entry, count, *total in found:
        out[entry] = np.array(total) // count
    return out.reshape(books.shape)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, code, error, label_error) of every sound row of (vec_id, embedding, label), and the codebooks (parts, entries, width).

    Components are integers, vectors cut into ``parts`` equal parts. Codebooks begin with the parts of the vectors of the smallest ids; a round
    assigns each part to its nearest entry and moves entries to means rounded down; last, parts are assigned. All arithmetic is exact.
    ``code``: two hex digits a part. ``error``: squared distances of all parts. ``label_error``: errors of a label added up (null if past 64 bits).

    Vectors are written once, as blocks of codes into dictionaries of each dimension's different integers. A task
    holds a block at a time. The driver holds the codebooks alone.

    Null vectors, and those with null or non-finite components, are dropped. The first kept vector, by id, whose length ``parts`` divides sets the
    length; vectors of other lengths, or with components beyond +-16,384, stay with null code and error. Null ids come after all others;
    equal ids are ordered by their vectors, a row each. Null labels are one label. Fewer vectors than ``entries``: as many entries. An empty table gives no rows and no
    entries. Other columns are ignored.
    """
    label = F.coalesce(F.concat(F.lit("="), vectors["label"].cast("string")), F.lit(""))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), label.alias("label"), vectors["embedding"].cast("array<double>").alias("x"))
    rows = rows.filter(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    whole = rows.withColumn("fits", F.forall("x", lambda c: F.abs(c) * SCALE < MOST))
    first = F.struct(F.col("vec_id").isNull(), "vec_id", "x")
    width = whole.filter(F.col("fits") & (F.size("x") > 0) & (F.size("x") % parts == 0)).agg(F.min_by(F.size("x"), first)).first()[0] or 0
    fits = F.col("fits") & (F.size("x") == width) & F.lit(width > 0)
    held = whole.filter(fits).select("vec_id", "label", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))
    seed = [r["v"] for r in held.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    books = np.array(seed, np.int64).reshape(len(seed), parts, width // parts).transpose(1, 0, 2)
    blocks = keep(held.mapInArrow(_blocks, _BLOCK), "vector-blocks")
    if seed:
        for _ in range(rounds):
            books = moved(blocks, books)
    coded = keep(assign(blocks, books), "vector-codes")
    drop(blocks)
    out = coded.unionByName(whole.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    sums = keep(out.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    return join_hot(out, sums, "label", ["vec_id", "code"]).select("vec_id", "code", "error", "label_error"), books


def digest_of(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and place, as decimals with commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("codebooks_sha256", F.lit(digest_of(books)))
