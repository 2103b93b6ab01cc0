import hashlib
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemill.llm.vector_codes import compress, decoded, digest_of, encode, nearest, op11_vector_codes


def brute(rows, parts=4, entries=256, rounds=4):
    """Vector by vector in whole numbers: {row: (code, error)} and codebooks."""
    kept = [(i, x) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    fits = lambda x: all(abs(c) < 16384 for c in x) and len(x) > 0 and len(x) % parts == 0
    ordered = sorted((r for r in kept if fits(r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    wide = len(ordered[0][1]) if ordered else 0
    ordered = [(i, [math.floor(1024 * c) for c in x]) for i, x in ordered if len(x) == wide]
    w = wide // parts
    books = [[x[p * w : p * w + w] for _, x in ordered[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x[p * w : p * w + w], e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds if ordered else 0):
        new = []
        for p in range(parts):
            own = {}
            for _, x in ordered:
                own.setdefault(best(p, x)[1], []).append(x[p * w : p * w + w])
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for i, x in kept:
        if fits(x) and len(x) == wide:
            found = [best(p, [math.floor(1024 * c) for c in x]) for p in range(parts)]
            out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        else:
            out.append((i, None, None))
    return out, books


def test_op11_on_embeddings(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").slice(0, 10**9)
    got = op11_vector_codes(spark, sf).collect()
    assert len(got) == t.num_rows
    x = np.floor(1024 * np.stack(t.column("embedding").to_pylist()).astype(float)).astype(np.int64)
    order = np.argsort(t.column("vec_id").to_numpy())
    books = x[order[:256]].reshape(-1, 4, 16).transpose(1, 0, 2).copy()
    parts = x.reshape(-1, 4, 16).transpose(1, 0, 2)
    for r in range(5):
        d = ((parts[:, :, None] - books[:, None]) ** 2).sum(3)
        at = d.argmin(2)
        for p in range(4 if r < 4 else 0):
            for k in np.unique(at[p]):
                books[p, k] = parts[p][at[p] == k].sum(0) // (at[p] == k).sum()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == {i: (bytes(a).hex(), int(e)) for i, a, e in zip(t.column("vec_id").to_pylist(), at.T.astype(np.uint8).tolist(), d.min(2).sum(0))}
    assert {r["codebooks_sha256"] for r in got} == {digest_of(books)} == {hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()}


def test_odd_rows(spark, monkeypatch):
    import tidemill.llm.vector_codes as module

    monkeypatch.setattr(module, "BLOCK", 7)
    monkeypatch.setattr(module, "CHUNK", 3)
    rng = random.Random(5)
    rows = [(k % 50, [rng.choice([-1.5, -0.25, 0.0, 0.3, 0.3, 1.0, 900.0]) for _ in range(8)]) for k in range(70)]
    rows += rows[:10] + [(None, rows[3][1]), (None, None), (7, None), (-5, [float("nan")] * 8), (-6, [1.0, None] * 4), (-7, [float("inf")] * 8), (-8, []), (-9, [1.0, 2.0, 3.0]), (-10, [1e30] * 8), (-11, [0.1] * 4), (-12, [16384.0] * 8), (90, [16383.9] * 8), (91, [-16383.9] * 8)]
    labels = [None if k % 5 == 0 else "" if k % 5 == 1 else "=" if k % 5 == 2 else str(k) for k in range(len(rows))]
    df = spark.createDataFrame([(i, x, y, "x") for (i, x), y in zip(rows, labels)], "vec_id long, embedding array<double>, label string, code string")
    for part, entries in ((df, 6), (df.filter("vec_id <> -11 OR vec_id IS NULL"), 6), (df.filter("vec_id <> -11"), 200)):
        own = [(r["vec_id"], r["embedding"]) for r in part.collect()]
        want, books = brute(own, entries=entries)
        out, got_books = compress(part, entries=entries)
        got = out.collect()
        assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=repr) == sorted(want, key=repr)
        assert got_books.tolist() == books
    by = {}
    for (_, _, e), y in zip(brute([(r["vec_id"], r["embedding"]) for r in part.collect()], entries=200)[0], [r["label"] for r in part.filter("embedding IS NOT NULL AND vec_id NOT IN (-5, -6, -7)").collect()]):
        by[y] = by.get(y, 0) + (e or 0)
    assert sorted({r["label_error"] for r in got if r["label_error"]}) == sorted({e for e in by.values() if e})
    empty, books = compress(df.limit(0))
    assert empty.collect() == [] and books.size == 0
    assert compress(df.filter("vec_id = -9"))[0].first()[1:] == (None, None, None)


@pytest.mark.parametrize("most", [3, 1000, 1 << 24])
def test_tables_give_exact_distances(most):
    rng = np.random.default_rng(most)
    x, books = rng.integers(-most, most, (300, 12)), rng.integers(-most, most, (3, 40, 4))
    block = encode(x)
    assert (decoded(*block) == x).all()
    best, least = nearest(*block, books)
    d = ((x.reshape(-1, 3, 4).transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(3)
    assert (best == d.argmin(2)).all() and (least == d.min(2)).all()
