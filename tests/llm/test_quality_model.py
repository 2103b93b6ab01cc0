import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemill.llm.quality_model import classify, fit_logistic, op1_site_quality, prior_weight


def test_op1_agrees_with_labels(spark, sf):
    t = pq.read_table(f"{sf}/labels.parquet").to_pylist()
    got = {r["doc_id"]: r for r in op1_site_quality(spark, sf).collect()}
    assert len(got) == pq.read_table(f"{sf}/documents.parquet").num_rows
    right = [got[r["doc_id"]]["kept"] == (r["quality"] == 1 and r["toxic"] == 0) for r in t]
    assert np.mean(right) >= 0.95


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{big}/documents.parquet").withColumn("host", F.lit(1))
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = classify(docs, labels.filter("doc_id % 3 != 0"), F.col("source"), F.concat_ws("/", "source", "lang"))
    truth = labels.filter("doc_id % 3 = 0").select("doc_id", "toxic", F.expr("quality = 1 AND toxic = 0").alias("good"))
    rows = got.select("doc_id", "kept").join(truth, "doc_id").collect()
    assert np.mean([r["kept"] == r["good"] for r in rows]) >= 0.96
    assert np.mean([r["kept"] for r in rows if r["good"]]) >= 0.97
    # nearly half of the toxic labels are noise: their texts hold none of the words that mark the others
    marks = {"stupid", "disgusting", "clown", "trash", "moron", "worthless", "scum", "pathetic", "idiot", "loser"}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rude = [r for r in got.select("doc_id", "kept").collect() if sum(w.strip(".,!").lower() in marks for w in texts[r["doc_id"]].split()) >= 2]
    assert len(rude) > 300 and np.mean([not r["kept"] for r in rude]) >= 0.98


def test_sparse_sites_shrink_and_odd_rows(spark):
    good, bad = "some plain words of a text number %d and more of it", "BUY NOW!! CHEAP!! %d !!"
    rows = [(k, good % k if k % 2 else bad % k, "a") for k in range(200)] + [(1000 + k, bad % k, "b") for k in range(100)] + [(2000, bad % 1, "c"), (2001, None, None), (2001, None, None), (None, "", "c"), (2003, good % 1 * 2000, "c")]
    docs = spark.createDataFrame([(i, t, h, "x", 1) for i, t, h in rows], "doc_id long, text string, source string, host string, quality int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 150)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels, F.col("source"), F.col("source")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["kept"] and not by[1000]["kept"] and by[1000]["host_posterior"] < by[2000]["host_posterior"] < by[1]["host_posterior"] + 0.2
    assert classify(docs.limit(0), labels, F.col("source"), F.col("source")).collect() == []
    blank = classify(docs, labels.limit(0), F.col("source"), F.col("source")).collect()
    assert {round(r["quality"], 6) for r in blank} == {0.5}


def test_logistic_and_prior():
    y = np.array([0.0, 1.0] * 50)
    w = fit_logistic(np.arange(1, 100, 2), np.zeros(50, np.int64), 1, np.zeros((100, 1)), y)
    assert w[0] > 2 and w[1] == 0 and w[2] < 0
    p = 1 / (1 + np.exp(-(w[0] * y + w[2])))
    assert abs(((y - p) * y).sum() - 0.1 * w[0]) < 1e-6  # the gradient vanishes
    assert prior_weight(0, 0, 0, 0) == 10.0 and prior_weight(100, 50, 25.0, 2) == 10_000.0


def test_posteriors_against_numpy_and_a_bad_site(spark):
    """Posteriors follow from the evidence alone; a site of bad documents turns the verdict on a middling one, a good site keeps it."""
    rng = np.random.default_rng(3)
    good, bad = [f"good{k}" for k in range(20)], [f"bad{k}" for k in range(20)]
    text = lambda share: " ".join(rng.choice(good if rng.random() < share else bad) for _ in range(30))
    rows = [(i, text(share), host, path) for i, (share, host, path) in enumerate([(0.8, "a", "x")] * 60 + [(0.2, "b", "y")] * 60 + [(0.2, "b", "z")] * 3 + [(0.7, "c", "w")] * 2)]
    middle = " ".join([*good[:15], *bad[:15]])
    rows += [(900, middle, "a", "x"), (901, middle, "b", "y"), (901, middle, "b", "y"), (None, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(host in "ac"), 0) for i, _, host, _ in rows[:120]] + [(0, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels, F.col("host"), F.col("path")).collect()
    assert len(got) == len(rows)
    e = np.array([r["evidence"] for r in got])
    mean = e.mean()

    def grouped(key):
        names = [key(r) for r in got]
        n = {k: sum(x == k for x in names) for k in set(names)}
        s = {k: sum(y for x, y in zip(names, e) if x == k) for k in n}
        return names, n, s, prior_weight(len(e), e.sum(), sum(s[k] ** 2 / n[k] for k in n), len(n))

    (hosts, hn, hs, k1), (paths, pn, ps, k2) = grouped(lambda r: r["host"]), grouped(lambda r: (r["host"], r["path"]))
    logit = lambda x: np.log(max(x, 1e-6) / max(1 - x, 1e-6))
    odds = lambda x: np.log(x / (1 - x))
    for r, h, p, x in zip(got, hosts, paths, e):
        host = (hs[h] - x + k1 * mean) / (hn[h] - 1 + k1)
        path = (ps[p] - x + k2 * host) / (pn[p] - 1 + k2)
        assert r["host_posterior"] == pytest.approx(host) and r["path_posterior"] == pytest.approx(path)
        assert odds(r["score"]) == pytest.approx(logit(x) + logit(path) - logit(mean), abs=1e-6)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[900]["evidence"] == pytest.approx(by[901]["evidence"]) and by[900]["score"] > by[900]["evidence"] > by[901]["score"]
    assert by[900]["kept"] and not by[901]["kept"]
