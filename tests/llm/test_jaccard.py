import random
import re

import pyarrow.parquet as pq
import pytest

from tidemill.llm.graph import components
import tidemill.llm.jaccard_join as jj
from tidemill.llm.jaccard_join import bits_of, jaccard_components, linked, op5_jaccard_join, overlap_bound, tile_bands
from tidemill.llm.shingles import shingle_sets

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, width=3):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, percent=90, width=3):
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t, width), []).append(i)
    found = {i: i for i, _ in rows}

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    def join(i, j):
        i, j = sorted((root(i), root(j)))
        found[j] = i

    for x, ids in sets.items():
        for j in ids if x else ():
            join(ids[0], j)
    kinds = sorted((x for x in sets if x), key=len)
    for k, x in enumerate(kinds):
        for y in kinds[k + 1 :]:
            if 100 * len(x) < percent * len(y):
                break
            shared = len(x & y)
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                join(sets[x][0], sets[y][0])
    return {i: (len(shingles(t, width)), root(i)) for i, t in rows}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_op5_on_documents(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    rows = list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()))
    assert result(op5_jaccard_join(spark, sf)) == brute(rows)


def test_borderline_groups(spark):
    rng, rows = random.Random(3), []
    for g in range(60):
        n = rng.choice([5, 9, 12, 13, 20, 22, 40, 60, 110, 240])
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        for _ in range(rng.choice([2, 5, 14])):
            words = list(base)
            for _ in range(rng.randrange(0, 2 + n // 20)):
                k = rng.randrange(len(words))
                if rng.random() < 0.5:
                    words[k] = f"x{rng.randrange(50)}"
                else:
                    del words[k : k + 1]
            text = " ".join(words) + rng.choice(["", "\n", " \t"])
            rows.append((len(rows), text.upper() if rng.random() < 0.2 else text))
    rng.shuffle(rows)
    for percent in (90, 80):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert result(jaccard_components(df, percent=percent)) == brute(rows, percent)


def test_open_tiles_are_compared(spark):
    """Members of a tile that are linked to each other but not to its smallest member."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    far = list(base)
    for k in range(0, 300, 12):
        far[k] = f"y{k}"
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(far)
        for k in rng.sample(range(300), 2):
            words[k] = f"z{i}"
        rows.append((i, " ".join(words)))
    want = brute(rows)
    assert len({c for _, c in want.values()}) == 2
    assert result(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A"), (5, "a"), (6, "a b"), (7, "A B"), (8, "é b c d"), (9, "É b c d"), (None, "a"), (11, "x y " * 9000), (12, "x\x0by\x0c" * 9000)]
    df = spark.createDataFrame([(i, t, "e", 0) for i, t in rows], "doc_id long, text string, n_shingles string, component_id int")
    want = brute([r for r in rows if r[0] is not None])
    got = result(df_ := jaccard_components(df))
    assert {k: v for k, v in got.items() if k is not None} == want and got[None] == (1, None) and df_.count() == 12
    assert jaccard_components(df.limit(0)).collect() == []
    again = jaccard_components(df.unionAll(df))
    assert again.count() == 24 and {k: v for k, v in result(again).items() if k is not None} == want


def test_first_elements_reach_what_linked_sets_share():
    for percent in (80, 90):
        for n in range(1, 400):
            for m in range(n, 100 * n // percent + 1):
                shared = next(i for i in range(n + 1) if linked(i, n, m, percent))
                if n + m > 2 * shared:
                    x, y = dict(tile_bands(n, percent)), dict(tile_bands(m, percent))
                    assert any(x[b] >= n - shared + 1 and y[b] >= m - shared + 1 for b in x.keys() & y.keys()), (n, m)


@pytest.mark.parametrize("small", [{"LOCAL": 2}, {"BLOCK": 3}, {"STAR": 2}, {"LOCAL": 3, "BLOCK": 2, "STAR": 1}])
def test_large_groups_take_the_same_links(spark, monkeypatch, small):
    """Bounds at which groups are dealt into parts do not change what is found."""
    for k, v in small.items():
        monkeypatch.setattr(jj, k, v)
    rng, rows = random.Random(7), []
    for g in range(5):
        base = [f"g{g}w{k}" for k in range(70)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(70)] = f"x{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, " ".join(f"g0w{j}" for j in range(70))) for k in range(30)]
    assert result(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_bitmap_bound_and_components(spark):
    x, y = shingle_sets(["a b c d e f g h", "a b c d e f g h i j k " * 3], 3)
    shared = len(set(x.tolist()) & set(y.tolist()))
    assert overlap_bound(len(x), len(y), bits_of(x), bits_of(y)) >= shared
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(90, 80), (80, 70), (5, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {**{k: 1 for k in range(1, 41)}, 70: 70, 80: 70, 90: 70}
    assert components(links.limit(0)).collect() == []
