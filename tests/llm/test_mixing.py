import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.llm.mixing import ORACLE, mixed_documents, mixture, op2_mix_to_weights, source_family


def test_op2_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, op2_mix_to_weights(spark, sf).collect())) == sorted(con.sql(ORACLE).fetchall())


def water(nodes, budget):
    """Shares of (name, weight, cap) by capping one node at a time."""
    out, open_ = {}, dict((n, (w, c)) for n, w, c in nodes)
    while open_:
        level = budget / sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c < level * w]
        if not full:
            return out | {n: level * w for n, (w, _) in open_.items()}
        for n in full:
            out[n] = open_.pop(n)[1]
            budget -= out[n]
    return out


def rows_of(spec):
    return [(k, " ".join(["w"] * n), lang, source, dom) for k, (dom, lang, source, n) in enumerate(spec)]


def test_shortage_goes_to_siblings_first(spark):
    spec = [("d1", "en", "a", 10)] * 4 + [("d1", "en", "b", 50)] * 40 + [("d1", "de", "c", 100)] * 20 + [("d2", "en", "e", 70)] * 60
    df = spark.createDataFrame(rows_of(spec), "doc_id long, text string, lang string, source string, domain string")
    leaves, chosen = mixture(df, F.col("domain"), {"domain": {"d1": 3, "d2": 1}, "lang": {"en": 1, "de": 1}, "source": {"a": 1, "b": 1}}, budget=4000, max_epochs=2)
    tokens = Counter()
    for d, lang, s, n in spec:
        tokens[d, lang, s] += n
    tops = water([("d1", 3, 2 * (40 + 2000 + 2000)), ("d2", 1, 2 * 4200)], 4000)
    langs = water([("en", 1, 2 * 2040), ("de", 1, 4000)], tops["d1"])
    want = {("d1", "en", s): v for s, v in water([("a", 1, 80), ("b", 1, 4000)], langs["en"]).items()}
    want |= {("d1", "de", "c"): langs["de"], ("d2", "en", "e"): tops["d2"]}
    got = {(r["domain"], r["lang"], r["source"]): r for r in leaves.collect()}
    assert {k: r["budget"] for k, r in got.items()} == {k: pytest.approx(v, abs=1) for k, v in want.items()}
    drawn, order = Counter(), defaultdict(list)
    for r in chosen.collect():
        k = (r["domain"], r["lang"], r["source"])
        drawn[k] += r["take_tokens"]
        order[k].append((hashlib.md5(f"1:{got[k]['epochs']}:{r['doc_id']}".encode()).hexdigest(), r["n_tokens"], r["take_tokens"] - got[k]["epochs"] * r["n_tokens"]))
    assert drawn == {k: r["budget"] for k, r in got.items()}
    for k, docs in order.items():
        left = got[k]["rest"]
        for _, n, taken in sorted(docs):
            assert taken == min(n, left)
            left -= taken


def test_each_document_stays_without_a_budget_and_odd_rows(spark):
    rows = [(1, None, None, None, "x"), (2, "", "en", "s", None), (3, "a b", "en", "s", "x"), (3, "a b", "en", "s", "x"), (None, "c", "de", "s", "x"), (5, "y " * 50_000, "fr", "t", "x")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, lang string, source string, domain string, budget int, key string")
    leaves, chosen = mixture(df, F.col("domain"), temperature=0.9)
    assert chosen.count() == 6 and all(r["copies"] >= 1 for r in chosen.collect() if r["n_tokens"])
    out = mixed_documents(df, F.col("domain"), temperature=0.9)
    assert out.columns == df.columns
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert all(kept[i, t] >= 1 for i, t, *_ in rows if t)
    empty = df.limit(0)
    assert mixture(empty, F.col("domain"))[1].collect() == [] and mixed_documents(empty, F.col("domain")).collect() == []


def test_documents_are_drawn_as_often_as_chosen(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    how = dict(temperature=0.5, budget_share=0.8)
    _, chosen = mixture(docs, source_family(), **how)
    want = {r["doc_id"]: r["copies"] for r in chosen.collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixed_documents(docs, source_family(), **how).select("doc_id").collect()) == want
