import hashlib
import re

import pyarrow.parquet as pq
import pytest

from tidemill.llm.fill_middle import checked, cut, fill_middle, fill_middle_documents, op13_fill_in_middle, restored

MARKERS = ("<P>", "<S>", "<M>")


def brute(doc_id, text):
    """One unit after the other."""
    text, units, at = text or "", [], 0
    unit = re.compile("[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+")
    while at < len(text):
        m = unit.match(text, at)
        units.append(m[0])
        at = m.end()
    digest, n = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest(), len(units)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in MARKERS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op13_on_documents(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    texts = dict(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()))
    got = op13_fill_in_middle(spark, sf).collect()
    assert len(got) == len(texts) and {r["form"] for r in got} == {"plain", "spm", "psm"}
    for r in got:
        *head, output = brute(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == tuple(head)
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(output), sha(texts[r["doc_id"]] or ""))


#: Texts with pieces of markers at their units' ends, where cuts put real ones beside them.
PIECES = ["a <", "P> b <P", "> <S", "S> é", "<M", " 日本\n\n", "\t", "<", ">", "M>x<", "word", "  ", "<<", "\x1c", "𐍈 "]


def test_odd_rows(spark):
    rows = [(k, "".join(PIECES[(k * j + k // 3) % len(PIECES)] for j in range(1, 4 + k % 9))) for k in range(300)]
    rows += [(1, None), (2, ""), (None, "a b c d"), (None, None), (9, " \n\t "), (9, " \n\t "), (11, "holds <M> itself"), (12, "long text " * 200_000), (13, "x" * 1_000_000)]
    df = spark.createDataFrame([(i, t, "mine", 7) for i, t in rows], "doc_id long, text string, form string, n int")
    found = fill_middle(df)
    got = found.withColumn("back", restored(found["output"], found["form"])).collect()
    want = sorted([(*brute(i, t), t or "") for i, t in rows], key=repr)
    assert sorted([tuple(r)[1:] for r in got], key=repr) == want
    assert any("<P" in r["output"].replace("<P>", "") and r["form"] != "plain" for r in got)
    assert fill_middle(df.limit(0)).collect() == []


def test_documents_keep_their_columns(spark):
    df = spark.createDataFrame([(k, f"one two three {k}", "mine", None) for k in range(40)] + [(None, None, None, "x")], "doc_id long, text string, form string, `odd. name` string")
    got = fill_middle_documents(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert sorted(r["text"] for r in rows) == sorted(brute(r["doc_id"], None if r["doc_id"] is None else f"one two three {r['doc_id']}")[-1] for r in rows)
    assert {r["form"] for r in rows} == {"mine", None}


def test_markers_that_could_be_mistaken():
    for bad in (("<P>", "<P>", "<M>"), ("", "b", "c"), ("aba", "x", "y"), ("ab", "xa", "y")):
        with pytest.raises(ValueError):
            checked(bad)
    assert cut("a b", 1, 2, 2, ("1", "2", "3")) == (2, "psm", 1, 2, "1a23 b")
