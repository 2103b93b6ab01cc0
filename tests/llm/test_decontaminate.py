import random
import re

import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from tidemill.llm.decontaminate import clean_documents, decontaminate, fingerprints, op12_winnow_decontaminate


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, span=10):
    out, held = [], {}
    for k, text in items:
        item = words(text)
        n = min(span, len(item))
        for i in range(len(item) - n + 1 if n else 0):
            held.setdefault(n, {}).setdefault(tuple(item[i : i + n]), set()).add(k)
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n, known in held.items():
            for i in range(len(w) - n + 1):
                if owners := known.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((doc_id, len(w), len(hit), sorted(str(k) for k in found if k is not None), bool(hit)))
    return sorted(out, key=repr)


def result(df):
    assert all(r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in df.collect())
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in df.collect()], key=repr)


def test_op12_on_documents(spark, sf):
    docs, items = pq.read_table(f"{sf}/documents.parquet"), pq.read_table(f"{sf}/benchmark.parquet")
    want = brute(zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()), list(zip(items.column("item_id").to_pylist(), items.column("text").to_pylist())))
    got = op12_winnow_decontaminate(spark, sf).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got], key=repr) == [(d, n, h, len(k), c) for d, n, h, k, c in want]
    assert any(r["contaminated"] for r in got) and not all(r["contaminated"] for r in got)


@pytest.mark.parametrize("broadcast", [True, False])
def test_few_words_often_repeated(spark, monkeypatch, broadcast):
    """Texts over few different words, so that hashes tie, windows recur and items share them; items of all lengths from none to many."""
    import tidemill.llm.common as common
    import tidemill.llm.decontaminate as module

    monkeypatch.setattr(module, "send_if_small", common.send_if_small if broadcast else lambda df: df)
    monkeypatch.setattr(module, "join_hot", lambda *a: common.join_hot(*a, most=5))
    rng = random.Random(3)
    text = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    items = [(k, text(k % 17, "abAé1")) for k in range(40)] + [(50, "a " * 30), (51, "A. a! " * 5), (51, "b b b b b b b b b b"), (None, "z z z"), (60, None), (61, "... "), (62, text(25, "abc"))]
    items += [(70 + k, "one passage that a third of the items share with one another word for word") for k in range(15)]
    docs = [(k, text(rng.randint(0, 60), "abAé1" if k % 2 else "abc")) for k in range(60)]
    docs += [(100, None), (101, ""), (None, "x z, Z-z y"), (None, "x z, Z-z y"), (102, "a " * 3000), (103, "one passage that a third of the items share with one another word, for word")]
    docs += [(104, "One passage that a third, of the items share with"), (105, "passage that a third of the items share with"), (106, items[-20][1] or ""), (107, "ÀÉ Z z À z z")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, row int")
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, m string")
    assert result(decontaminate(d, b)) == brute(docs, items)
    assert result(decontaminate(d, b.limit(0))) == brute(docs, [])
    assert decontaminate(d.limit(0), b).collect() == []
    clean = clean_documents(d, b)
    assert clean.columns == d.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in clean.collect()))) == sorted(repr(x) for x in docs if not brute([x], items)[0][-1])


@pytest.mark.parametrize("length", [1, 2, 5, 9, 10])
def test_equal_spans_keep_equal_fingerprints(spark, length):
    rng = random.Random(length)
    spans = [[rng.choice("abcd") for _ in range(length)] for _ in range(50)]
    rows = [(k, ["x"] * rng.randint(0, 5) + s + [rng.choice("ab")] * rng.randint(0, 7)) for k, s in enumerate(spans) for _ in range(4)]
    def prints(rows):
        df = spark.createDataFrame(rows, "k int, w array<string>").withColumn("_h", F.transform("w", lambda x: F.xxhash64(x)))
        return fingerprints(df, length, "f").select("k", "f.m").collect()

    got, alone = prints(rows), {r["k"]: set(r["m"]) for r in prints(list(enumerate(spans)))}
    assert all(len(alone[k]) == 1 for k in alone) and all(alone[r["k"]] <= set(r["m"]) for r in got)


def test_no_python_in_the_plan(spark, sf):
    plan = op12_winnow_decontaminate(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|MapPartitions", plan)
