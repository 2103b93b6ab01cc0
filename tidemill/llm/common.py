"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.scratch import drop, scratch_dir, shared_dir
from tidemill.sources.scratch import stored as keep

__all__ = ["SEPARATORS", "WORD", "drop", "free_name", "join_hot", "keep", "numbered", "scratch_dir", "send_if_small", "shared_dir", "text_of"]

#: ASCII white space, the only separators of words.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Tables of at most so many bytes (rows times the width of their columns) are sent to all executors; larger ones are joined by a shuffle.
SEND_BYTES = 32 << 20
_WIDTH = {"bigint": 8, "int": 4, "smallint": 2, "tinyint": 1, "boolean": 1, "double": 8, "float": 4, "date": 4, "timestamp": 8}


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def send_if_small(df: DataFrame, most: int = SEND_BYTES) -> DataFrame:
    """Broadcast a written table if its values have at most ``most`` bytes in all; else leave it to a shuffle."""
    wide = [c for c, t in df.dtypes if t not in _WIDTH]
    size = lambda c: F.coalesce(F.octet_length(F.col(c) if dict(df.dtypes)[c] == "binary" else F.col(c).cast("string")), F.lit(0))
    each = F.lit(sum(_WIDTH.get(t, 0) for _, t in df.dtypes)) + sum((size(c) for c in wide), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(each.cast("long"))).first()[0] or 0) <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as set it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows written with a number of their own (long) in column ``name``, by which they are told apart whatever their ids."""
    return keep(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], spread: list[str], how: str = "inner", most: int = 100_000, heaviest: int | None = None) -> DataFrame:
    """``left`` (many rows of a key) joined with ``right`` (one or few rows of a key).

    A key with over ``most`` rows on the left is dealt into parts by hash of the columns ``spread``; its rows on the right
    go to each part. Hot keys are at most rows / ``most``, and are counted by partial sums. ``heaviest``: rows of the heaviest key, where known.
    """
    keys = [key] if isinstance(key, str) else key
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if heaviest is None:
        heaviest = counts.agg(F.max("_n")).first()[0] or 0
    if heaviest <= most:
        return left.join(right, keys, how)
    sent = send_if_small(keep(counts.filter(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_parts")), "hot-keys"))
    parts = F.coalesce("_parts", F.lit(1))
    many = left.join(sent, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    few = right.join(sent, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return many.join(few, [*keys, "_part"], how).drop("_part")
