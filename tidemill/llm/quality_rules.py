"""Host-level quality rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, join_hot, keep, text_of

MIN_WORDS = 20
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def text_measures(docs: DataFrame, host: str = "source", whole: bool = False) -> DataFrame:
    """doc_id, host and the counts of every whole text; ``whole``: also ``row``, all columns of the document as one."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]) if whole else F.lit(0)
    rows = docs.select(row.alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[host].cast("string"), F.lit("")).alias("host"), text_of(docs).alias("_text"))
    rows = rows.withColumn("_w", F.array_remove(F.split("_text", SEPARATORS), ""))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    rows = rows.withColumn("_lines", lines).withColumn("_h1", F.transform("_w", lambda x: F.xxhash64(x)))
    # hashes of 2, 4 and 8 words from where each begins; what runs past the end is cut off last
    for step, before, after in ((1, "_h1", "_h2"), (2, "_h2", "_h4"), (4, "_h4", "_h8")):
        rows = rows.withColumn(after, F.zip_with(before, F.slice(before, step + 1, F.greatest(F.size(before) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    n = F.size("_w")
    rows = rows.withColumn("_h8", F.slice("_h8", 1, F.greatest(n - (WINDOW - 1), F.lit(0))))
    rows = rows.withColumn("_again", F.size(F.array_distinct("_h8")) < F.size("_h8"))
    # only texts with a repeated window sort their windows
    rows = rows.withColumn("_s", F.when(F.col("_again"), F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = lambda e, k: F.coalesce(F.get("_s", k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == e["h"], F.lit(False))
    rows = rows.withColumn("_at", F.when(F.col("_again"), F.sort_array(F.transform(F.filter("_s", twice), lambda e: e["i"]))))
    covered = F.aggregate(F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda s, x: s + x)
    long = lambda c, name: c.cast("long").alias(name)
    return rows.select(
        *(["row"] if whole else []),
        "doc_id",
        "host",
        long(n, "n_words"),
        long(F.length(F.translate("_text", " \t\n\x0b\f\r", "")), "word_chars"),
        long(F.length("_text") - F.length(F.translate("_text", SYMBOLS, "")), "n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines")), "n_dup_lines"),
        long(F.when(F.col("_again"), covered).otherwise(0), "n_repeat_words"),
        long(F.size("_lines"), "n_lines"),
    )


def host_rules(docs: DataFrame, host: str = "source", max_host_rate: float = 0.5, whole: bool = False) -> DataFrame:
    """Judge documents by rules and by how often the documents of their host fail.

    A document fails its own rules if it has under 20 words or if more than 30 % of its
    words lie in 8-word windows that occur twice. Two further rules count against the
    host only: over a tenth as many symbols as words, and over 30 % repeated lines. A host's failure
    rate is shrunk towards all hosts by a beta prior fitted to them by moments; a host
    whose shrunk rate exceeds ``max_host_rate`` takes all its documents down. ``kept``: the document
    passes and its host does. ``whole``: the result also has ``row``, all columns of the document as one.

    The measures are written once (a few numbers a document); hosts are counted by partial sums before
    any shuffle, the prior is three sums over hosts, and verdicts are joined by host and part.

    Null text: no words, so it fails. Null host: a host of its own, ''. Null or repeated ids: a row each, judged by its own text.
    Very long texts are measured whole. An empty table gives no rows. Columns other than ``doc_id``, ``text`` and the host are ignored.
    """
    measures = keep(text_measures(docs, host, whole), "measures")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    soft = (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    judged = measures.withColumn("base_failed", base)
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.count_if(base | soft).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    x = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.sum(F.col("host_docs") * rate * rate).alias("s"), F.count(F.lit(1)).alias("k")).first()
    alpha, beta = beta_prior(x["n"] or 0, x["f"] or 0, float(x["s"] or 0), x["k"])
    verdicts = hosts.withColumn("host_rate", (F.col("host_failed") + alpha) / (F.col("host_docs") + (alpha + beta)))
    # a host may hold a large share of all documents: its verdict goes to parts of them, in proportion to how many it has
    verdicts = keep(verdicts, "verdicts")
    out = join_hot(judged, verdicts, "host", ["doc_id", "n_words", "word_chars"])
    return out.select(*(["row"] if whole else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)).alias("kept"), "host", "host_docs", "host_failed", "host_rate")


def passing_documents(docs: DataFrame, host: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """The documents that :func:`host_rules` keeps, with their own columns. Each row is judged by itself, so null and repeated ids need no care."""
    return host_rules(docs, host, max_host_rate, whole=True).filter("kept").select("row.*")


def beta_prior(n: int, failed: int, sum_sq: float, hosts: int) -> tuple[float, float]:
    """Moments of host rates, weighted by documents: mean and spread beyond that of chance."""
    if not n:
        return 1.0, 1.0
    mean = (failed + 0.5) / (n + 1)
    chance = mean * (1 - mean) * hosts / n
    spread = max(sum_sq / n - (failed / n) ** 2 - chance, 1e-6)
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0)
    return mean * weight, (1 - mean) * weight


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host_rate")
