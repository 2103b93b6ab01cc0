"""Bulk-synchronous best-fit packing of token sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, send_if_small, text_of
from .tokens import Encoder, crc32_of, in_chunks, lists

_PIECES = "doc_id long, piece int, start long, length int, ids array<int>, ids_crc32 long, part int, nth long"


def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, piece number and length of all pieces; the first piece of a long document is the shorter one."""
    n = -(-counts // capacity)
    doc = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, piece, np.where(piece == 0, counts[doc] - (n[doc] - 1) * capacity, capacity)


def token_pieces(docs: DataFrame, vocabulary: str, kind: str, end: int, capacity: int, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents. ``nth``: which piece of its length it is within its task (``part``)."""

    def pieces(batches):
        encoder, seen = Encoder.get(vocabulary, kind), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts):
                ids, counts = encoder.encode(texts[a:b], end)
                doc, piece, length = cut(counts, capacity)
                ends = np.cumsum(length)
                start = ends - length - (np.cumsum(counts) - counts)[doc]
                by = np.argsort(length, kind="stable")
                nth = np.empty(len(doc), np.int64)
                nth[by] = np.arange(len(doc)) - np.searchsorted(length[by], length[by])
                nth += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), lists(ids, ends) if with_ids else pa.nulls(len(doc), pa.list_(pa.int32())), pa.array(crc32_of(ids, ends)), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "nth"],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(pieces, _PIECES)


#: Kinds of runs: ``n`` gaps of one size in sequences from ``first`` on; ``n`` unplaced documents of one length by rank from ``first`` on;
#: documents placed in sequences from ``sequence`` on.
GAP, DOC, PLACED = 0, 1, 2
_RUNS = "kind int, size int, first long, n long, sequence long, at int"


def sweep(runs: list[tuple[int, int, int, int]], capacity: int) -> tuple[list, list, list]:
    """Match runs (kind, size, first, n) of documents with runs of gaps, each with its successor: the smallest gap that holds it and no longer document takes.

    One pass from large sizes to small. The k-th document of a run takes the k-th gap of its successor run, or several in a
    row if gaps hold several and enough are there. A gap is used by one run only; what it has left is for the next superstep. Returns placed runs, gaps and documents left.
    """
    placed, gaps, docs, open_gaps = [], [], [], []
    for kind, size, first, n in sorted(runs, key=lambda r: (-r[1], r[0], r[2])):
        if kind == GAP:
            open_gaps.append((size, first, n))
            continue
        while n and open_gaps:
            gap, sequence, m = open_gaps.pop()
            each = gap // size
            for layers, k in ((each, min(m, n // each)), (n % each, int(n // each < m and n % each > 0))):
                if k:
                    placed += [(PLACED, size, first + x * k, k, sequence, capacity - gap + x * size) for x in range(layers)]
                    first, n, sequence, m = first + layers * k, n - layers * k, sequence + k, m - k
                    if gap > layers * size:
                        gaps.append((GAP, gap - layers * size, sequence - k, k))
            if m:
                open_gaps.append((gap, sequence, m))
        if n:
            docs.append((DOC, size, first, n))
    return placed, gaps + [(GAP, *g) for g in open_gaps], docs


def open_sequences(gaps: list, docs: list, capacity: int, opened: int) -> tuple[list, list, list]:
    """Open sequences for documents longer than all gaps: as many as their tokens need at least, each with one of the longest."""
    largest = max((g[1] for g in gaps), default=0)
    most = max(-(-sum(size * n for _, size, _, n in docs if size > largest) // capacity), sum(n for _, size, _, n in docs if size > largest and 2 * size > capacity))
    placed, gaps, left = [], list(gaps), []
    for _, size, first, n in sorted(docs, key=lambda r: (-r[1], r[2])):
        k = min(n, most)
        if k:
            placed.append((PLACED, size, first, k, opened, 0))
            if size < capacity:
                gaps.append((GAP, capacity - size, opened, k))
            opened, most = opened + k, most - k
        if n > k:
            left.append((DOC, size, first + k, n - k))
    return placed, gaps, left


def superstep(runs: DataFrame, capacity: int, opened: int, ranges: int) -> DataFrame:
    """One superstep over a table of runs: sweeps within ranges of sizes, a sweep across them of what is left, new sequences, and gaps updated.

    The sweep across ranges is one task: it reads runs, whose number depends on ``capacity`` and not on how many documents they stand for.
    """

    def read(batches):
        return [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("kind", "size", "first", "n", "sequence", "at")))]

    def write(placed, gaps, docs):
        rows = [*placed, *((*r, 0, 0) for r in (*gaps, *docs))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["kind", "size", "first", "n", "sequence", "at"])

    def within(batches):
        yield from write(*sweep([r[:4] for r in read(batches)], capacity))

    def across(batches):
        rows = read(batches)
        placed, gaps, docs = sweep([r[:4] for r in rows if r[0] != PLACED], capacity)
        more, gaps, docs = open_sequences(gaps, docs, capacity, opened)
        yield from write([*(r for r in rows if r[0] == PLACED), *placed, *more], gaps, docs)

    dealt = runs.filter(F.col("kind") != PLACED).repartitionByRange(ranges, "size")
    return dealt.mapInArrow(within, _RUNS).repartition(1).mapInArrow(across, _RUNS)


def match(counts: DataFrame, capacity: int, ranges: int = 8) -> DataFrame:
    """Best fit in bulk-synchronous supersteps: placed runs (length, low, high, first, at) for a table (length, n) of how often each length occurs.

    Lengths are integers up to ``capacity``, so the sorted order of documents and that of gaps are held as runs of equal sizes, and members of a run are
    told apart by rank, which also settles who takes which gap. Supersteps repeat until no document is left. Each fills every gap that
    holds an unplaced document once, so their number depends on how many lengths fill a sequence, not on how many documents there are (at most 10 in the
    tests' distributions of 300,000 lengths).
    """
    spark = counts.sparkSession
    runs = counts.select(F.lit(DOC).alias("kind"), F.col("length").cast("int").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("sequence"), F.lit(0).alias("at"))
    steps, opened, left = [], 0, True
    while left:
        runs = keep(superstep(runs, capacity, opened, ranges), "superstep")
        steps.append(runs)
        new = F.when((F.col("kind") == PLACED) & (F.col("at") == 0), F.col("sequence") + F.col("n"))
        top, left = runs.agg(F.max(new), F.count_if(F.col("kind") == DOC)).first()
        opened = max(opened, top or 0)
    found = spark.createDataFrame([], _RUNS)
    for step in steps:
        found = found.unionByName(step)
    return found.filter(F.col("kind") == PLACED).select(F.col("size").alias("length"), F.col("first").alias("low"), (F.col("first") + F.col("n")).alias("high"), F.col("sequence").alias("first"), F.col("at").cast("long").alias("at"))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give every kept piece a ``sequence_id`` and an ``offset``.

    ``pieces`` is a written table of :func:`token_pieces`. A piece's rank among its length is its number within its task plus
    the pieces of that length in earlier tasks, so no task ever sorts a whole length, however common it is. Ranks meet the rows of
    :func:`match`, whose number depends on ``capacity``.
    """
    runs = keep(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "runs")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    plan = keep(match(runs.groupBy("length").agg(F.sum("n").alias("n")), capacity), "plan")
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(send_if_small(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select("doc_id", "piece", "start", ranked["length"].cast("long").alias("length"), "ids", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("at").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, kind: str = "byte", end: int = 0, capacity: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pack whole documents into few sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id,
    offset. Documents longer than ``capacity`` are cut into full pieces after a first one
    that may be shorter; others stay whole. ``with_ids=False`` leaves ``ids`` null.

    Null text: packed as empty (the end id alone). Null or repeated ids: each row is
    packed on its own. An empty table gives no rows. Ties in length are told apart by rank.
    Columns other than ``doc_id`` and ``text`` are ignored.
    """
    return pack(keep(token_pieces(docs, vocabulary, kind, end, capacity, with_ids), "pieces"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")
