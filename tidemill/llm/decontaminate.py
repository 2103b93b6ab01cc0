"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, join_hot, keep, numbered, send_if_small, text_of

#: Words of so many characters of text a window holds: shared spans of this length or more are found.
SPAN = 10
#: What separates words, once letters are lower case: ASCII characters but digits and letters.
OUTSIDE = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words, A-Z in lower case. ``lower`` would change other letters too, so it is for texts of ASCII alone; it is faster."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, OUTSIDE), "")


def hashes_of(text: Column) -> Column:
    return F.transform(words_of(text), lambda x: F.xxhash64(x))


# Arrays that are unfolded here are never empty. The outer form of ``inline`` says so to the planner too: for the inner one it would add a filter on
# the array's size below the columns it is made of, and there compute each of them anew for every element.


def fingerprints(rows: DataFrame, length: int, out: str, words: str = "_h") -> DataFrame:
    """``rows`` with the winnowed fingerprints of an array of word hashes, for spans of ``length`` words, as the array column ``out``.

    Grams of k = (length + 1) div 2 words are hashed; of each ``length`` words in sequence, a window, the least hash of a gram is kept, so equal
    spans of ``length`` words keep equal hashes. Windows in sequence with one least hash are one fingerprint: {length, m: the hash,
    s: where the first of them begins, grams: all grams of those windows}. The first and last gram of a window cover it, so both
    hashes (128 bits) stand for its words.
    """
    k = (length + 1) // 2
    n, wide = F.size(words), length - k + 1
    span = lambda first, end: F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))
    # places after the last gram or window hold what is never looked at
    rows = rows.withColumn("_g", F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, k)])))
    rows = rows.withColumn("_m", F.transform("_g", lambda x, i: F.least(x, *[F.get("_g", i + j) for j in range(1, wide)]) if wide > 1 else x))
    rows = rows.withColumn("_s", F.filter(span(F.lit(0), n - (length - 1)), lambda i: (i == 0) | (F.get("_m", i) != F.get("_m", i - 1))))
    grams = lambda s, e: F.transform(span(s, F.coalesce(e, n - (length - 1)) + (length - k)), lambda j: F.get("_g", j))
    one = lambda s, e: F.struct(F.lit(length).alias("length"), F.get("_m", s).alias("m"), s.alias("s"), grams(s, e).alias("grams"))
    runs = F.zip_with("_s", F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), one)
    return rows.withColumn(out, runs).drop("_g", "_m", "_s")


def windows(grams: str = "grams", length: str = "length", start: str = "s") -> Column:
    """The windows of a fingerprint: {a, b: hashes of first and last gram, s: begin}."""
    apart = F.expr(f"CAST({length} div 2 AS INT)")
    return F.transform(F.sequence(F.lit(0), F.size(grams) - apart - 1), lambda j: F.struct(F.get(grams, j).alias("a"), F.get(grams, j + apart).alias("b"), (F.col(start) + j).alias("s")))


def item_windows(items: DataFrame, span: int, item_id: str, text: str) -> tuple[list[int], DataFrame, DataFrame, DataFrame]:
    """Lengths of windows, and tables: fingerprints (length, m), windows (length, a, b, set_id) and sets of items (set_id, items)."""
    rows = keep(items.select(items[item_id].cast("string").alias("item"), hashes_of(text_of(items, text)).alias("_h")).withColumn("length", F.least(F.size("_h"), F.lit(span))), "items")
    lengths = sorted(r["length"] for r in rows.filter("length > 0").select("length").distinct().collect())
    parts = [fingerprints(rows.filter(F.col("length") == n).drop("length"), n, "_f").select("item", F.inline_outer("_f")) for n in lengths]
    prints = reduce(DataFrame.unionByName, parts) if parts else fingerprints(rows.filter("length > 0").drop("length"), span, "_f").select("item", F.inline_outer("_f"))
    found = prints.select("length", "m", "item", F.inline_outer(windows()))
    found = keep(found.groupBy("length", "m", "a", "b").agg(F.array_sort(F.collect_set("item")).alias("items")), "item-windows")
    sets = keep(found.select("items").distinct().withColumn("set_id", F.monotonically_increasing_id()), "item-sets")
    return lengths, found.select("length", "m").distinct(), keep(found.join(send_if_small(sets), "items").select("length", "a", "b", "set_id"), "window-sets"), sets


def _merged(hits: Column) -> Column:
    """Spans [start, end) of words within hits (s, length) in order."""

    def add(spans, x):
        last = F.get(spans, F.size(spans) - 1)
        end = x["s"] + x["length"]
        apart = (F.size(spans) == 0) | (x["s"] > last["end"])
        new = F.struct(x["s"].alias("start"), end.alias("end"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))
        return F.when(apart, F.concat(spans, F.array(new))).otherwise(F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(longer)))

    return F.aggregate(hits, F.array().cast("array<struct<start:int,end:int>>"), add)


def _shared(rows: DataFrame, items: DataFrame, span: int, item_id: str, text: str) -> DataFrame:
    """row, doc_id, n_words, n_hit, spans and items for rows (row, doc_id, _h); see :func:`decontaminate`."""
    lengths, prints, known, sets = item_windows(items, span, item_id, text)
    for n in lengths:
        rows = fingerprints(rows, n, f"_f{n}")
    # each document also sends a row of its own, with a hash of its own, so that it stays if nothing is found and no task gets all of these
    own = F.struct(F.lit(0).alias("length"), F.xxhash64("row").alias("m"), F.lit(0).alias("s"), F.array(F.xxhash64("row")).alias("grams"))
    sent = rows.select("row", "doc_id", F.size("_h").alias("n_words"), F.inline_outer(F.concat(F.array(own), *[f"_f{n}" for n in lengths])))
    met = sent.join(send_if_small(keep(prints.withColumn("known", F.lit(True)), "item-prints")), ["length", "m"], "left").filter("known OR length = 0")
    ends = met.select("row", "doc_id", "n_words", "length", F.inline_outer(windows()))
    ends = ends.join(send_if_small(known), ["length", "a", "b"], "left").filter("set_id IS NOT NULL OR length = 0")
    hit = F.when(F.col("set_id").isNotNull(), F.struct("s", "length"))
    by_row = ends.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hits"), F.sort_array(F.collect_set("set_id")).alias("sets"))
    found = by_row.select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), _merged(F.col("hits")).alias("spans"), "sets")
    found = keep(found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])), "shared")
    named = found.filter("n_hit > 0").select("sets").distinct().withColumn("set_id", F.explode("sets")).join(send_if_small(sets), "set_id")
    named = keep(named.select("sets", F.explode("items").alias("item")).groupBy("sets").agg(F.array_sort(F.collect_set("item")).alias("items")), "items-of-sets")
    hot = join_hot(found.filter("n_hit > 0"), named, "sets", ["row"], "left")
    columns = ["row", "doc_id", "n_words", "n_hit", "spans"]
    none = F.array().cast("array<string>")
    return hot.select(*columns, F.coalesce("items", none).alias("items")).unionByName(found.filter("n_hit = 0").select(*columns, none.alias("items")))


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit (words within shared windows), spans of such words, items that share them, and contaminated, for every document.

    A window is ``span`` consecutive words of an item, or all words of an item that has fewer. Winnowed fingerprints of documents are
    joined with those of the items; where one meets, the hit is extended over the windows around it, which are joined by all their words. Every window that
    occurs in a document is found: it keeps the same hash there. A fingerprint leaves one row whatever the number of items that hold it, and items are
    kept as sets, so frequent passages and copies of items multiply nothing. Fingerprints are about 2 in 7 words for spans of 10; items of fewer words add those of
    their length. Tables of the items are broadcast up to a size checked in bytes, else joined by a shuffle. Only what meets is grouped by document.

    Null and empty texts have no words; such items match nothing. Null ids of documents: a row each. Items with null ids make documents
    contaminated but are not listed; equal ids are listed once. Repeated rows: a row each. Very long texts are compared whole. Empty tables: no rows, or nothing found. Other
    columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), hashes_of(text_of(docs)).alias("_h"))
    return _shared(rows, items, span, item_id, text).drop("row").withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents that share no window with an item, with their own columns of any name; odd rows as in :func:`decontaminate`."""
    name = free_name(docs, "row")
    rows = numbered(docs, name)
    found = _shared(rows.select(rows[name].alias("row"), F.lit(None).cast("long").alias("doc_id"), hashes_of(text_of(rows)).alias("_h")), items, span, "item_id", "text")
    return rows.join(found.filter("n_hit > 0").select(F.col("row").alias(name)), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op12_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")
