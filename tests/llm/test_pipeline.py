import sys
from collections import Counter, defaultdict

import corpus_pipeline
from test_jaccard import brute as brute_links
from test_secrets import brute as brute_secrets
from tidemill.llm.common import keep
from test_tokens_packing_rules import check_packing, ids_of, rule_counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    before = {r["doc_id"]: r for r in docs.collect()}

    passed = keep(stages["quality_rules"](spark, docs, sf), "t")
    assert passed.columns == COLUMNS
    kept = {r["doc_id"]: r for r in passed.collect()}
    assert set(kept) == {i for i, r in before.items() if not rule_counts(r["text"])[5]}  # no host of this table fails

    single = keep(stages["near_duplicates"](spark, passed, sf), "t")
    links = brute_links([(i, r["text"]) for i, r in kept.items()], 80, 5)
    left = {r["doc_id"]: r for r in single.collect()}
    assert single.columns == COLUMNS and set(left) == {i for i, (_, c) in links.items() if i == c}

    clean = keep(stages["secrets"](spark, single, sf), "t")
    safe = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == COLUMNS and set(safe) == set(left)
    for i, r in safe.items():
        assert brute_secrets(r["text"])[:3] == (0, 0, 0) and r["n_chars"] == len(r["text"])
        assert r["text"] == left[i]["text"] or "[SECRET]" in r["text"]

    mixed = keep(stages["mixing"](spark, clean, sf), "t")
    drawn = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == COLUMNS and set(drawn) == set(safe) and max(drawn.values()) <= 5

    rows = stages["packing"](spark, mixed, sf).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    copy = []  # pieces of repeated documents dealt to copies, for the check of one document at a time
    for i, pieces in by.items():
        seen = Counter()
        for r in pieces:
            copy.append({**r.asDict(), "doc_id": (i, seen[r["piece"]])})
            seen[r["piece"]] += 1
    names = [((i, k), safe[i]["text"]) for i in drawn for k in range(drawn[i])]
    check_packing(copy, names, 2048, ids_of([t for _, t in names], "byte_bpe_50k.json", 0))


def test_run_keeps_to_the_stages(spark):
    small = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, small)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secrets", "mixing", "packing"]
    assert "corpus_pipeline" in sys.modules


WORDS = " ".join(f"w{k}" for k in range(40))
ODD = [
    (None, "a b c", "en", "s", 5), (None, WORDS, "en", "s", 9), (None, WORDS + " more", "en", "s", 9), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0),
    (3, "word " * 30, "de", "t", 150), (3, "x" + WORDS, "de", "t", 150), (4, " ".join(f"v{k}" for k in range(60_000)), "de", "t", 9), (5, WORDS + " more", None, None, 1), (5, WORDS + " more", None, None, 1),
]


def frame(spark, rows):
    extra = ["epochs", "cut", "row", "copies", "copy", "_row", "key", "host", "kept", "domain", "component", "text_a", "tiles"]
    names = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r, *extra) for r in rows], names), [*COLUMNS, *extra]


def test_stages_take_odd_rows(spark):
    """Null and repeated ids, null, empty and very long texts, clashing columns: exactly these rows stay."""
    docs, columns = frame(spark, ODD)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)
    out = stages["quality_rules"](spark, docs, "")
    assert out.columns == columns and key(out.collect()) == sorted([(i, t) for i, t, *_ in ODD if not rule_counts(t or "")[5]], key=repr)
    out = stages["near_duplicates"](spark, docs, "")
    left = [(None, "a b c"), (1, None), (2, ""), (2, ""), (3, "word " * 30), (3, "x" + WORDS), (4, ODD[8][1]), (5, WORDS + " more")]
    # the texts of WORDS, with and without an end or a beginning more, are one group each way linked: 3 has the smallest id
    links = brute_links(list(enumerate(t for _, t, *_ in ODD)), 80, 5)
    group = {links[k][1] for k, r in enumerate(ODD) if r[1] and WORDS in r[1]}
    if len(group) == 1:
        left.remove((5, WORDS + " more"))
    assert out.columns == columns and key(out.collect()) == sorted(left, key=repr)
    out = stages["secrets"](spark, docs, "")
    assert out.columns == columns and key(out.collect()) == sorted([(i, t) for i, t, *_ in ODD], key=repr)
    out = stages["mixing"](spark, docs, "")
    drawn = Counter(key(out.collect()))
    assert out.columns == columns and set(drawn) == {(i, t) for i, t, *_ in ODD} and drawn[2, ""] % 2 == 0 and drawn[5, WORDS + " more"] % 2 == 0
    rows = stages["packing"](spark, docs, "").collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ODD) and all(len(r["ids"]) == r["length"] for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), "")
        assert out.collect() == [] and (name == "packing" or out.columns == columns)
