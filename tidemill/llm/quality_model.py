"""Quality classifier: document evidence and hierarchical empirical Bayes over sites."""

from __future__ import annotations

from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, keep, text_of

#: Labelled rows the classifier is fitted on at most, and how far from chance the words must be that it knows.
MAX_LABELS, MIN_Z = 10_000, 4.0
#: Fixed numeric features, by name.
SHAPE = ("log_words", "word_length", "upper", "digits", "symbols", "exclaims", "bars", "repeated_lines", "distinct_words")
_MARKS = ".,;:!?\"'()[]{}*#$%&|<>"
_SEPARATORS = str.maketrans({c: " " for c in "\t\n\x0b\f\r"})


def _words(text: str) -> list[str]:
    return [w for w in text.translate(_SEPARATORS).split(" ") if w]


def _plain(text: str) -> set[str]:
    """Distinct words in lower case, without marks around them."""
    return {w.strip(_MARKS) for w in _words(text.lower())}


def shape(text: str, words: list[str]) -> list[float]:
    n, c = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZÉÈÊÄÖÜÑÓÍÁÇ"))
    return [log(1 + len(words)), sum(map(len, words)) / n, letters / c, sum(map(text.count, "0123456789")) / c, sum(map(text.count, "#*$%&<>")) / n, text.count("!") / n, text.count("|") / n, 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / n]


def fit_logistic(row: np.ndarray, word: np.ndarray, n_words: int, numbers: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 30) -> np.ndarray:
    """Weights of words, numbers and the intercept by Newton's method. Words are given by (row, word) of those present; each step is solved by conjugate gradients."""
    n = len(y)
    ridge = np.full(n_words + numbers.shape[1] + 1, l2)
    ridge[-1] = 1e-6
    times = lambda w: np.bincount(row, w[word], n) + numbers @ w[n_words:-1] + w[-1]
    back = lambda r: np.concatenate([np.bincount(word, r[row], n_words), numbers.T @ r, [r.sum()]])
    w = np.zeros(len(ridge))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        spread, rest = p * (1 - p), back(y - p) - ridge * w
        step, way, size = np.zeros(len(w)), rest.copy(), rest @ rest
        goal = 1e-16 * size
        for _ in range(200):
            if size <= goal:
                break
            turned = back(spread * times(way)) + ridge * way
            far = size / (way @ turned)
            step += far * way
            rest = rest - far * turned
            size, before = rest @ rest, size
            way = rest + size / before * way
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Two logistic models, of low quality and of toxicity, on word presence and text shape."""

    def __init__(self, words: list[str], mean, spread, quality, toxic):
        self.words, self.mean, self.spread, self.quality, self.toxic = {w: k for k, w in enumerate(words)}, mean, spread, quality, toxic

    def features(self, text: str) -> tuple[list[int], list[float]]:
        words = _words(text)
        present = [self.words[w] for w in self.words.keys() & _plain(text)]
        return present, shape(text, words)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of good quality and of toxicity."""
        rows = [self.features(t) for t in texts]
        numbers = np.clip((np.array([r[1] for r in rows]).reshape(len(rows), len(SHAPE)) - self.mean) / self.spread, -8, 8)
        k = len(self.words)
        found = [np.array([w[r[0]].sum() for r in rows]) + numbers @ w[k:-1] + w[-1] for w in (self.quality, self.toxic)]
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in found)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Fit on at most ``max_labels`` labelled documents, those of the smallest hashes of ids; that bound also holds for what reaches the driver.

    Several labels of a document count by their majority, as ones where they are even.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(*[(F.avg(c) >= 0.5).cast("int").alias(c) for c in ("quality", "toxic")])
    chosen = keep(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels), "labels")
    sample = keep(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "quality", "toxic"), "sample")

    def count(batches):
        found, total = Counter(), 0
        for batch in batches:
            for text, q, t in zip(*(batch.column(c).to_pylist() for c in ("text", "quality", "toxic"))):
                for w in _plain(text):
                    found[w, q, t] += 1
            if len(found) > 2_000_000:
                yield from emit(found)
                found.clear()
        yield from emit(found)

    def emit(found):
        if found:
            w, q, t = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(q, pa.int32()), pa.array(t, pa.int32()), pa.array(list(found.values()), pa.int64())], ["word", "quality", "toxic", "n"])

    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("q"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    per = sample.mapInArrow(count, "word string, quality int, toxic int, n long").groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("q"), F.sum(F.col("n") * F.col("toxic")).alias("t"))
    z = lambda c, total: F.abs(F.col(c) - F.col("n") * total) / F.sqrt(F.col("n") * (total * (1 - total)) + 1.0)
    m = max(1, totals["n"])
    strength = F.greatest(z("q", F.lit(totals["q"] / m)), z("t", F.lit(totals["t"] / m)))
    words = [r[0] for r in per.filter(strength >= MIN_Z).orderBy("word").select("word").collect()]
    blank = Model(words, 0.0, 1.0, None, None)

    def describe(batches):
        for batch in batches:
            rows = [blank.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("toxic"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["quality", "toxic", "present", "shape"])

    rows = sample.mapInArrow(describe, "quality int, toxic int, present array<int>, shape array<double>").collect()
    numbers = np.array([r["shape"] for r in rows]).reshape(len(rows), len(SHAPE))
    mean, spread = (numbers.mean(0), np.maximum(numbers.std(0), 1e-3)) if len(rows) else (np.zeros(len(SHAPE)), np.ones(len(SHAPE)))
    numbers = np.clip((numbers - mean) / spread, -8, 8)
    row = np.repeat(np.arange(len(rows)), [len(r["present"]) for r in rows]).astype(np.int64)
    word = np.array([w for r in rows for w in r["present"]], np.int64)
    heads = [fit_logistic(row, word, len(words), numbers, np.array([r[c] for r in rows], float)) if rows else np.zeros(len(words) + len(SHAPE) + 1) for c in ("quality", "toxic")]
    return Model(words, mean, spread, *heads)


def prior_weight(n: float, total: float, sum_sq: float, sites: int) -> float:
    """How many documents the prior counts as, from the spread of site means beyond chance (moments)."""
    if n <= 0:
        return 10.0
    mean = min(max(total / n, 1e-3), 1 - 1e-3)
    spread = max(sum_sq / n - (total / n) ** 2 - mean * (1 - mean) * sites / n, 1e-6)
    return min(max(mean * (1 - mean) / spread - 1, 10.0), 10_000.0)


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, host, path, quality, toxicity, evidence, posteriors, score and kept.

    ``evidence``: the classifier's probability that a document is of good quality and not toxic. Host means of
    it shrink towards the mean of all documents, path means towards their host's, by prior weights fitted to the spread of
    sites. Posteriors of a document's host and path are those without the document itself, so its evidence counts once. The path's posterior
    replaces the common prior in the document's odds: score = sigmoid(logit evidence + logit path - logit all), odds within a million to one. ``kept``: score at or over ``threshold``. Sites are counted by partial sums before any shuffle.

    Null text: empty; very long texts are read whole. Null host or path: ''. Documents need no label; labels with nulls are passed over, repeated ones count by
    their majority. Without labels every document's evidence is one half. Null or repeated ids: a row each. An empty table gives no rows. Other
    columns are ignored.
    """
    model = fit(docs, labels, max_labels)
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def score(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = [model.score(texts[k : k + 2000]) for k in range(0, len(texts), 2000)]
            q, t = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(q), pa.array(t)], ["doc_id", "host", "path", "quality", "toxicity"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), name(host).alias("host"), name(path).alias("path"), text_of(docs).alias("text"))
    scored = keep(rows.mapInArrow(score, "doc_id long, host string, path string, quality double, toxicity double").withColumn("evidence", F.col("quality") * (1 - F.col("toxicity"))), "scores")
    paths = keep(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s")), "paths")
    hosts = keep(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")), "hosts")
    sums = lambda df, n, s: df.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(s), F.lit(0.0)), F.coalesce(F.sum(F.col(s) * F.col(s) / F.col(n)), F.lit(0.0)), F.count(F.lit(1))).first()
    of_hosts, of_paths = sums(hosts, "host_n", "host_s"), sums(paths, "n", "s")
    mean = of_hosts[1] / of_hosts[0] if of_hosts[0] else 0.5
    k1, k2 = prior_weight(*of_hosts), prior_weight(*of_paths)
    sites = keep(join_hot(paths, hosts, "host", ["path"]), "sites")
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    joined = join_hot(scored, sites, ["host", "path"], ["doc_id", "evidence"])
    joined = joined.withColumn("host_posterior", (F.col("host_s") - F.col("evidence") + k1 * mean) / (F.col("host_n") - 1 + k1))
    joined = joined.withColumn("path_posterior", (F.col("s") - F.col("evidence") + k2 * F.col("host_posterior")) / (F.col("n") - 1 + k2))
    joined = joined.withColumn("score", 1 / (1 + F.exp(-(logit(F.col("evidence")) + logit(F.col("path_posterior")) - logit(F.lit(float(mean)))))))
    return joined.select("doc_id", "host", "path", "quality", "toxicity", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("kept"))


def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
