import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import tidemill.llm.language_model as lm

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows):
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = tokens(t)
        out.append((i, held(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return out


def check(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(brute(rows), key=key), strict=True):
        assert tuple(g[:5]) == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and math.isfinite(g[6]) and g[6] <= 1e-6


@pytest.mark.parametrize("head", [lm.HEAD, 500])
def test_op7_base_and_gain(spark, sf, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    t = pq.read_table(f"{sf}/documents.parquet")
    rows = list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()))
    got = lm.op7_maxent_score(spark, sf).collect()
    check(got, rows)
    for part in (True, False):
        own = [r for r in got if r["held_out"] == part]
        gain = (sum(r["score"] for r in own) - sum(r["base_score"] for r in own)) / sum(r["n_tokens"] for r in own)
        assert gain > 0.05, (part, gain)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    w, prior = rng.normal(size=(lm.BUCKETS, lm.CLASSES)), np.log(rng.dirichlet(np.ones(lm.CLASSES)))
    p = np.exp(lm.log_softmax(w, prior, lm.feature_rows(np.arange(50))))
    assert np.allclose(p.sum(1), 1)
    v, at = np.array([3, 4, 0, 5, 0]), np.array([0, 3, 5])
    c = lm.CLASSES
    assert lm.contexts(v, at).tolist() == [0, 3 * c * c, 4 * c * c + 3 * c, 0, 5 * c * c]


def test_word_probabilities_sum_to_one_and_fit():
    """Over all words of a class, after any words before, seen or not; weights stand where their gradients vanish."""
    rng = np.random.default_rng(1)
    own = rng.integers(0, 3, 40).astype(np.int64)
    share = rng.dirichlet(np.ones(40))
    share /= np.bincount(own, share)[own]
    seen = np.stack([rng.integers(0, 4, 600), rng.integers(0, 4, 600), rng.integers(0, 30, 600)])
    asked = np.stack([x.ravel() for x in np.meshgrid(range(5), range(5), range(40))])
    every = np.concatenate([seen, asked], 1).astype(np.uint32)
    train = np.arange(every.shape[1]) < 600
    by = np.lexsort((every[2], every[1], every[0]))
    key, w2, w = every[:, by]
    gain = lm.fit_words(key.astype(np.uint64), w2, w, own[w], share[w], train[by])
    p = share[w] * 10**gain
    for x in range(5):
        for y in range(5):
            for c in range(3):
                at = ~train[by] & (key == x) & (w2 == y) & (own[w] == c)
                assert at.sum() == (own == c).sum() and p[at].sum() == pytest.approx(1)
    assert np.log10(p[train[by]]).sum() > np.log10(share[w[train[by]]]).sum() + 50
    # a word seen 100 times after another one comes near its share of what was seen
    key, w = np.zeros(201, np.uint64), np.sort(np.r_[np.zeros(100, np.uint32), np.arange(1, 101), 200]).astype(np.uint32)
    gain = lm.fit_words(key, np.zeros(201, np.uint32), w, np.zeros(201, np.int64), np.full(201, 1 / 300), np.ones(201, bool))
    assert 0.4 < 10 ** gain[0] / 300 < 0.5


def test_odd_rows(spark):
    rows = [(k, "the cat sat on the mat. The dog ran") for k in range(20)] + [(1, None), (2, ""), (2, ""), (None, "the cat"), (30, "new\x0bwords É é"), (31, "x " * 50_000), (10, " \n ")]
    df = spark.createDataFrame([(i, t, "s", 1.0) for i, t in rows], "doc_id long, text string, row string, score double")
    check(lm.score_documents(df).collect(), rows)
    assert lm.score_documents(df.limit(0)).collect() == []
    only = [(i, "a b c") for i in range(60) if held(i)]
    check(lm.score_documents(spark.createDataFrame(only, "doc_id long, text string")).collect(), only)


def test_word_sequences_count(spark, monkeypatch):
    """Two documents with the same classes at all places differ by whether their words were seen together."""

    def classes(train, words):
        c = np.full(words + 2, 1 + lm.SINGLES)
        c[: 1 + lm.SINGLES] = np.arange(1 + lm.SINGLES)
        c[-1] = lm.CLASSES - 1
        return c

    monkeypatch.setattr(lm, "word_classes", classes)
    n = lm.SINGLES
    pair = lambda i, k: f"left{i} right{(i + k) % n}"
    ids = [i for i in range(2000) if held(i)][:2]
    text = lambda i, k: " ".join(pair((i * 7 + j * 11) % (3 * n), k) for j in range(n))
    rows = [(i, text(i, 0)) for i in range(200) if not held(i)] + [(ids[0], text(5, 0)), (ids[1], text(5, 1))]
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[ids[0]] > got[ids[1]] + 10


def test_weights_come_to_the_driver_once_and_match_numpy(spark, monkeypatch):
    """Each step sends the driver every row of the weight table once at most, in small pieces; the fit is that of one process."""
    monkeypatch.setattr(lm, "STEPS", 3)
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, lm.CLASSES, n).tolist() + [0] for n in rng.integers(0, 40, 1500)]
    sent, frame = [], type(spark.range(0))

    def seen(rows):
        rows = list(rows)
        if rows and "total" in rows[0].asDict():
            sent.append([len(r["total"]) for r in rows])
        return rows

    for name in ("collect", "toLocalIterator"):
        monkeypatch.setattr(frame, name, lambda self, *a, f=getattr(frame, name), **k: seen(f(self, *a, **k)))
    train = spark.createDataFrame([(t,) for t in texts], "codes array<int>").repartition(8)
    weights, prior = lm.train_weights(train, np.arange(lm.CLASSES))
    assert len(sent) == 4
    for pieces in sent:
        assert max(pieces) < 500_000 and sum(pieces) <= lm.BUCKETS * lm.CLASSES * 4

    v, at = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    context, of = np.unique(lm.contexts(v, at), return_inverse=True)
    n = np.zeros((len(context), lm.CLASSES))
    np.add.at(n, (of, v), 1)
    p = np.bincount(v, minlength=lm.CLASSES) + 0.5
    assert np.allclose(prior, np.log(p / p.sum()))
    rows, w = lm.feature_rows(context), np.zeros((lm.BUCKETS, lm.CLASSES))
    for _ in range(lm.STEPS):
        seen_n, wanted = np.zeros_like(w), np.zeros_like(w)
        expected = np.exp(lm.log_softmax(w, prior, rows)) * n.sum(1, keepdims=True)
        for r in rows:
            np.add.at(seen_n, r, n)
            np.add.at(wanted, r, expected)
        w += 2 / len(rows) * (seen_n - wanted - 0.1 * w) / (np.maximum(seen_n, wanted) + 2)
    assert np.abs(w).max() > 0.3 and np.allclose(weights, w, atol=1e-4)
