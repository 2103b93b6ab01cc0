import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemill.llm.embedding_dedup import close_pairs, forest, near_duplicates, op6_embedding_dedup, prepared, quantise


def brute(rows, threshold=0.95):
    n, x = len(rows), []
    ok = [v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    found = {}
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min(rows[j][0] for j in seen)
        found[k] = (len(links[i]), c, c == k)
    return found


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_op6_on_embeddings(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet")
    x = np.stack(t.column("embedding").to_pylist()).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    got = result(op6_embedding_dedup(spark, sf))
    assert [got[i][0] for i in t.column("vec_id").to_pylist()] == (near.sum(1) - 1).tolist()


@pytest.mark.parametrize("group_bytes", [16 << 20, 1])
def test_groups_and_odd_rows(spark, monkeypatch, group_bytes):
    import tidemill.llm.embedding_dedup as module

    monkeypatch.setattr(module, "TILE", 16)
    monkeypatch.setattr(module, "PIVOTS", 3)
    monkeypatch.setattr(module, "GROUP_BYTES", group_bytes)
    rng, rows = np.random.default_rng(1), []
    for _ in range(12):
        base = rng.normal(size=24)
        for s in rng.uniform(0, 0.6, 12):
            rows.append((base + s * rng.normal(size=24) * rng.uniform(0, 1)).astype(np.float32).tolist())
    rows = [*rows, *rows[:30], [0.0] * 24, None, [float("nan")] * 24, [1.0, None], [1.0, 2.0], [2.0, 4.0], [float("inf"), 1.0], [], [0.0, 0.0], [3 * x for x in rows[3]]]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows)]
    df = spark.createDataFrame([(i, v, "e", i) for i, v in rows], "vec_id long, embedding array<float>, n_links string, k1 long")
    assert result(near_duplicates(df)) == brute(rows)
    assert near_duplicates(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert sorted((r[0] or 0, r[1], r[2] or 0, r[3]) for r in near_duplicates(odd).collect()) == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_very_large_and_small_components(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [1.0, 2.0]), (4, [-1e300, 1e-300]), (5, [5e-324, 0.0])]
    got = result(near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (0, 5, True)}


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 48))
    x = np.vstack([x, x + rng.normal(size=x.shape) * rng.uniform(0, 0.5, (200, 1))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q, s, e = quantise(u)
    p = q / s[:, None]
    assert (np.abs(u @ u.T - p @ p.T) <= e[:, None] + (1 + e[:, None]) * e[None] + 1e-12).all()
    got = {(i, j) for a, b in close_pairs(prepared(x), prepared(x), 0.9) for i, j in zip(a.tolist(), b.tolist())}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(u @ u.T >= 0.9))))
    i, j = np.array([1, 2, 5, 7]), np.array([2, 3, 6, 7])
    a, b = forest(i, j, 9)
    assert dict(zip(a.tolist(), b.tolist())) == {2: 1, 3: 1, 6: 5}
