import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidemill.llm.packing import match, op4_best_fit_packing, pack_documents, sweep
from tidemill.llm.quality_rules import beta_prior, host_rules, op9_host_rules
from tidemill.llm.token_files import op3_token_orc, read_token_files, with_crc32, write_token_files
from tidemill.llm.tokens import Encoder

ODD = [
    (1, None), (2, ""), (3, "Straße ﬁne İstanbul ΣΑΣ é  x y 日本語 'S don't 12½"), (4, "a  b\n\n c\t\td   "), (5, "<|endoftext|> <|startoftext|>"), (6, "a<|endoftext|>b <|ENDOFTEXT|> <| x"),
    (5, "x " * 9000), (7, "tie tie"), (8, "tie tie"), (None, "no id"), (9, "A\x00B\x1f\x0b\x0c\x85 ŸŊſK"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "l", "s", 0, "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string")


def ids_of(texts, name, end):
    tk = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*e.ids, end] for e in tk.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def documents(sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    return list(zip(t.column("doc_id").to_pylist(), [x or "" for x in t.column("text").to_pylist()]))


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_cached_words_give_the_librarys_ids(name, kind):
    texts = [t or "" for _, t in ODD] * 2
    flat, n = Encoder(public_tokenizers.path(name), kind).encode(texts, 7)
    want = ids_of(texts, name, 7)
    assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_a_full_cache_changes_no_ids(monkeypatch):
    import tidemill.llm.tokens as module

    monkeypatch.setattr(module, "CACHE_WORDS", 50)
    monkeypatch.setattr(module, "KEPT_WORDS", 20)
    own, texts = Encoder(public_tokenizers.path("byte_bpe_50k.json"), "byte"), [" ".join(f"word{(j * k) % 97}" for j in range(40)) for k in range(20)]
    for _ in range(2):
        for t in texts:
            flat, _ = own.encode([t], 0)
            assert flat.tolist() == ids_of([t], "byte_bpe_50k.json", 0)[0]
        assert own.known <= 50 + 97


def test_op3_against_the_library(spark, sf):
    docs, start = sorted(documents(sf)), 0
    want = []
    for (i, _), ids in zip(docs, ids_of([t for _, t in docs], "word_bpe_49k.json", 1)):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, op3_token_orc(spark, sf).collect())) == want


def test_op3_odd_rows_and_pruning(spark, tmp_path):
    path = str(tmp_path / "orc")
    write_token_files(frame(spark, ODD), path, public_tokenizers.path("word_bpe_49k.json"), partitions=3)
    back = read_token_files(spark, path)
    rows = sorted(map(tuple, back.collect()), key=lambda r: r[1])
    want = sorted(((i, t or "") for i, t in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r[0] for r in rows] == [i for i, _ in want]
    assert [r[3] for r in rows] == ids_of([t for _, t in want], "word_bpe_49k.json", 1)
    assert [r[1] for r in rows] == np.cumsum([0, *(len(r[3]) for r in rows)])[:-1].tolist()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in back.filter("doc_id = 7")._jdf.queryExecution().toString()
    empty = str(tmp_path / "empty")
    write_token_files(frame(spark, []), empty, public_tokenizers.path("word_bpe_49k.json"))
    assert with_crc32(read_token_files(spark, empty)).collect() == []


def test_op3_files_hold_row_indexes_and_bloom_filters(spark, tmp_path):
    """As their footers say: a row index for every column, Bloom filters on doc_id alone, ids as run-length encoded integers."""
    path = str(tmp_path / "orc")
    write_token_files(frame(spark, [(k, f"text number {k} " * 5) for k in range(500)]), path, public_tokenizers.path("word_bpe_49k.json"), partitions=2)
    jvm, conf, files = spark._jvm, spark._jsc.hadoopConfiguration(), sorted((tmp_path / "orc").glob("part-*.orc"))
    assert len(files) == 2
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        names = list(reader.getSchema().getFieldNames())
        columns = {reader.getSchema().getChildren().get(k).getId(): n for k, n in enumerate(names)}
        rows = reader.rows()
        footer = rows.readStripeFooter(reader.getStripes().get(0))
        streams = [(s.getKind().toString(), columns.get(s.getColumn())) for s in footer.getStreamsList()]
        assert {c for k, c in streams if k == "ROW_INDEX" and c} == set(names)
        assert {c for k, c in streams if k.startswith("BLOOM_FILTER")} == {"doc_id"}
        assert "DIRECT_V2" in {footer.getColumns(k).getKind().toString() for k in range(footer.getColumnsCount())}
        rows.close()


def check_packing(rows, docs, capacity, ids):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for (i, _), t in zip(docs, ids):
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        lengths = [r["length"] for r in pieces]
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(lengths) == len(t)
        assert len(t) <= capacity and len(pieces) == 1 or set(lengths[1:]) == {capacity}
        for r in pieces:
            assert r["ids_crc32"] == crc(t[r["start"] : r["start"] + r["length"]])
        assert [r["start"] for r in pieces] == np.cumsum([0, *lengths])[:-1].tolist()
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_op4_against_the_library(spark, sf):
    docs = documents(sf)
    ids = ids_of([t for _, t in docs], "byte_bpe_50k.json", 0)
    n = check_packing(op4_best_fit_packing(spark, sf).collect(), docs, 2048, ids)
    assert n <= 1.01 * -(-sum(map(len, ids)) // 2048) + 1


def test_op4_odd_rows(spark):
    rows = [(k, t) for k, (_, t) in enumerate(ODD)]
    ids = ids_of([t or "" for _, t in rows], "byte_bpe_50k.json", 0)
    got = pack_documents(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), capacity=64).collect()
    check_packing(got, rows, 64, ids)
    assert all(len(r["ids"]) == r["length"] for r in got)
    assert pack_documents(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    assert len(pack_documents(frame(spark, ODD), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048).collect()) > len(ODD)


def best_fit(lengths, capacity):
    """Sequences that best fit in falling order opens, one document at a time."""
    gaps, opened = [0] * (capacity + 1), 0
    for n in sorted(lengths, reverse=True):
        gap = next((g for g in range(n, capacity + 1) if gaps[g]), None)
        if gap is None:
            gap, opened = capacity, opened + 1
        else:
            gaps[gap] -= 1
        gaps[gap - n] += 1
    return opened


def placed(found, capacity):
    """Sequences of placed runs, once each document is seen to be there once and none to overlap."""
    ranks, used = defaultdict(int), defaultdict(list)
    for r in found:
        ranks[r["length"]] += r["high"] - r["low"]
        for k in range(r["high"] - r["low"]):
            used[r["first"] + k].append((r["at"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return ranks, len(used)


def test_matching_is_best_fit_and_bounded(spark, monkeypatch):
    rng = np.random.default_rng(0)
    cases = [(Counter({7: 3, 5: 4, 3: 10, 2: 1}), 10), (Counter({1: 100_000}), 2048), (Counter({700: 1000, 600: 1000, 10: 100}), 2048), (Counter({2048: 5}), 2048)]
    cases += [(Counter(x.tolist()), 2048) for x in (rng.integers(1, 2049, 3000), rng.integers(1, 40, 9000), np.clip(rng.lognormal(6, 1.2, 4000).astype(int) + 1, 1, 2048))]
    import tidemill.llm.packing as packing

    steps = []
    monkeypatch.setattr(packing, "superstep", lambda *a, own=packing.superstep: steps.append(1) or own(*a))
    for counts, capacity in cases:
        steps.clear()
        found = match(spark.createDataFrame(list(counts.items()), "length int, n long"), capacity, 4).collect()
        ranks, n = placed(found, capacity)
        assert ranks == counts and len(steps) <= 12
        assert n <= 1.01 * best_fit(counts.elements(), capacity) + 1
    assert match(spark.createDataFrame([], "length int, n long"), 10).collect() == []


def test_a_sweep_gives_each_document_its_successor():
    got, gaps, docs = sweep([(0, 9, 0, 1), (0, 6, 5, 2), (1, 5, 0, 2), (1, 7, 0, 1), (1, 8, 0, 1)], 10)
    assert got == [(2, 8, 0, 1, 0, 1), (2, 5, 0, 2, 5, 4)] and gaps == [(0, 1, 0, 1), (0, 1, 5, 2)] and docs == [(1, 7, 0, 1)]


WORD = re.compile("[^\x20\x09-\x0d]+")


def rule_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit.update(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


def test_op9_against_python(spark, sf):
    docs = documents(sf)
    got = {r["doc_id"]: r for r in op9_host_rules(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == rule_counts(t)
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_op9_odd_rows(spark):
    bad = [(100 + k, "# " * 50) for k in range(40)]
    rows = [*ODD, (50, "a b c d e f g h a b c d e f g h a b c d e f g h"), (51, "é 日 x\x0by\x0cz " * 3 + "\n\n l1\nl1\nl1")]
    df = spark.createDataFrame([(i, t, "l", None if i == 2 else "s", 0, 5) for i, t in rows] + [(i, t, "l", "bad", 0, 5) for i, t in bad] + [(200 + k, " ".join(f"w{j * k}" for j in range(30)), "l", "s", 0, 5) for k in range(1, 60)], "doc_id long, text string, lang string, source string, n_chars long, n_words long")
    got = host_rules(df).collect()
    assert len(got) == len(rows) + len(bad) + 59
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        if i != 5:
            assert tuple(by[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == rule_counts(t or "")
    assert not any(by[i]["kept"] for i, _ in bad) and by[201]["kept"] and by[2]["host"] == ""
    assert host_rules(df.limit(0)).collect() == [] and beta_prior(0, 0, 0.0, 0) == (1.0, 1.0)


def test_hosts_take_down_documents_that_pass_their_own_rules(spark):
    """Equal texts, of a host whose documents mostly fail and of one whose do not; few failures among few documents shrink to the mean of all."""
    text = lambda k: " ".join(f"w{j * k}" for j in range(1, 31))
    rows = [(k, "# & " * 5, "bad") for k in range(60)] + [(100 + k, text(k), "bad") for k in range(1, 6)]
    rows += [(1000 + k, text(k), "good") for k in range(1, 300)] + [(2000, "too short", "few"), (2001, text(1), "few")]
    got = {r["doc_id"]: r for r in host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(not got[100 + k]["base_failed"] and not got[100 + k]["kept"] and got[1000 + k]["kept"] for k in range(1, 6))
    assert got[2001]["kept"] and got[2001]["host_failed"] * 2 >= got[2001]["host_docs"] and got[2001]["host_rate"] <= 0.5
