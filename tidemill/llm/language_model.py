"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

p(word | history) = p(class | history) * p(word | class, history). The class has n-gram and skip features of the three classes before, hashed into one table whose
weights the driver updates by gradients; a task sums those of the rows it owns. The word has features of the words before it, kept and updated by the task that has all tokens after the same word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, text_of
from .shingles import U, mix, word_hashes
from .tokens import in_chunks

#: Words with a code of their own (the most frequent ones); all others are in the last class.
HEAD = 131_072
#: Words that are a class each, words that others are grouped by, groups, and the rank that splits a group in two.
SINGLES, SEEDS, GROUPS, BAND = 30, 64, 8, 4096
CLASSES = 1 + SINGLES + 2 * GROUPS + 1
#: Rows of the hashed weight table, and gradient steps.
BUCKETS, STEPS = 16_384, 25
#: Rows of the weight table that are summed in one place, so that a step sends the driver each row once, in pieces of some 400 kB.
OWNED = 2_048
#: Gradient steps of the word features, their size, and the pull of each weight to zero (the inverse variance of its Gaussian prior).
WORD_STEPS, WORD_RATE, WORD_PULL = 6, 0.6, 1.0
#: Tokens dealt to a part, tokens after one word that are fitted together, and documents whose gains are added up in a part; tasks take several parts
#: one after the other where there are more parts than tasks.
DEAL, FIT, ROWS, MOST_TASKS = 400_000, 200_000, 100_000, 20_000
#: Gains that a task holds before it adds up those of the same document.
FOLD = 500_000
END = np.int64(0x7E57AB1E0DD5EED)
#: Which of the three classes before a token each feature looks at: n-grams, then skips.
FEATURES = ((1, 0, 0), (1, 1, 0), (1, 1, 1), (0, 1, 0), (0, 1, 1), (1, 0, 1))
_CODED = "row long, doc_id long, held_out boolean, codes array<int>, tails array<long>"


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, with END after each text, and tokens of each text."""
    words, n = word_hashes(texts)
    ends = np.cumsum(n)
    return np.insert(words.view(np.int64), ends, END), n + 1


def word_counts(rows: DataFrame) -> DataFrame:
    """h, c: how often each word (by its hash) occurs. Tasks count what they read before anything is shuffled."""

    def count(batches):
        held, size = [], 0

        def done():
            parts = [np.unique(x, return_counts=True) for x in held]
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "c"])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts, 1_000_000):
                held.append(_tokens(texts[a:b])[0])
                size += len(held[-1])
                if size > 3_000_000:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return rows.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def head_count(words: DataFrame, most: int) -> int:
    """The least count at which no more than ``most`` words occur so often.

    Found from how many words share each count, so that no more than the head itself is ever gathered.
    """
    n = 0
    for c, m in words.groupBy("c").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("c")).limit(most).collect():
        n += m
        if n > most:
            return c + 1
    return 1


def coded(rows: DataFrame, head: np.ndarray) -> DataFrame:
    """Documents as codes (0: END, then words by rank, last: all others) and the hashes of those others."""
    by = np.argsort(head)
    known, code = head[by], by.astype(np.int32) + 1
    rest = len(head) + 1

    def encode(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts, 1_000_000):
                tokens, n = _tokens(texts[a:b])
                at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
                codes = np.where(known[at] == tokens, code[at], rest).astype(np.int32) if len(known) else np.full(len(tokens), rest, np.int32)
                codes[tokens == END] = 0
                ends = np.concatenate([[0], np.cumsum(n)])
                out = codes == rest
                tails = np.concatenate([[0], np.cumsum(out)])[ends]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("row", "doc_id", "held_out")), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes)), pa.ListArray.from_arrays(pa.array(tails, pa.int32()), pa.array(tokens[out]))],
                    ["row", "doc_id", "held_out", "codes", "tails"],
                )

    return rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(encode, _CODED)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in a row, and the offsets of its lists (none null)."""
    offsets = np.asarray(column.offsets)
    return column.flatten().to_numpy(), offsets - offsets[0]


def _slices(batches, most: int = 500_000):
    """Batches cut to about ``most`` tokens, at least one document each."""
    for batch in batches:
        at, a = np.asarray(batch.column("codes").offsets), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def _cells(size: int, cells):
    """A mapper that counts cells of each batch and returns those that occur."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in _slices(batches):
            for found in cells(*_lists(batch.column("codes"))):
                total += np.bincount(found, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return count


def seed_groups(table: np.ndarray, groups: int) -> np.ndarray:
    """Cluster seed words by which seeds follow and precede them (k-means from far-apart starts)."""
    x = np.sqrt(np.hstack([table, table.T]) + 0.0)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    centers = [x[0]]
    for _ in range(min(groups, len(x)) - 1):
        centers.append(x[np.argmin(np.max(x @ np.array(centers).T, axis=1))])
    c = np.array(centers)
    for _ in range(20):
        own = np.argmax(x @ c.T, axis=1)
        for g in range(len(c)):
            if (own == g).any():
                c[g] = x[own == g].mean(0)
                c[g] /= max(np.linalg.norm(c[g]), 1e-9)
    return own


def word_classes(train: DataFrame, words: int) -> np.ndarray:
    """Class of each code: END, frequent words, groups of words that keep the same company in two bands of frequency, the rest."""
    rest = words + 1

    def seed_pairs(v, at):
        a, b = v[:-1], v[1:]
        ok = (a > 0) & (b > 0) & (a <= SEEDS) & (b <= SEEDS)
        yield (a[ok].astype(np.int64) - 1) * SEEDS + b[ok] - 1

    collect = lambda size, cells: train.select("codes").mapInArrow(_cells(size, cells), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(SEEDS * SEEDS)
    for r in collect(SEEDS * SEEDS, seed_pairs).collect():
        table[r[0]] = r[1]
    own = seed_groups(table.reshape(SEEDS, SEEDS), GROUPS)
    group = np.full(rest + 1, -1)
    group[1 : 1 + min(SEEDS, words)] = own[: min(SEEDS, words)]

    def company(v, at):
        g = group[v]
        for k in (1, 2):
            for word, near in ((v[:-k], g[k:]), (v[k:], g[:-k])):
                ok = (near >= 0) & (word > 0) & (word < rest)
                yield word[ok].astype(np.int64) * GROUPS + near[ok]

    met = collect((rest + 1) * GROUPS, company).withColumn("word", F.expr(f"cell div {GROUPS}").cast("int")).withColumn("g", (F.col("cell") % GROUPS).cast("int"))
    totals = {r["g"]: r["n"] for r in met.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    share = F.col("n") / F.try_element_at(F.create_map(*[x for g in range(GROUPS) for x in (F.lit(g), F.lit(float(totals.get(g, 1))))]), F.col("g"))
    classes = np.full(rest + 1, 1 + SINGLES)
    of = met.groupBy("word").agg(F.max_by("g", F.struct(share, "g")).alias("g")).toArrow()
    classes[of["word"].to_numpy()] = 1 + SINGLES + of["g"].to_numpy()
    classes[BAND + 1 :] += GROUPS
    classes[0 : 1 + SINGLES] = np.arange(min(len(classes), 1 + SINGLES))
    classes[rest] = CLASSES - 1
    return classes


def contexts(v: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of the three classes before each token; before a document's start they count as END."""
    place = np.arange(len(v)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.zeros(len(v), np.int64)
    for k in (1, 2, 3):
        before = np.zeros(len(v), np.int64)
        before[k:] = v[:-k]
        before[place < k] = 0
        out = out * CLASSES + before
    return out


def feature_rows(context: np.ndarray) -> list[np.ndarray]:
    """Row of the weight table of each feature, for each context."""
    g = (context // CLASSES**2, context // CLASSES % CLASSES, context % CLASSES)
    out = []
    for k, use in enumerate(FEATURES):
        key = np.full(len(context), k + 1, np.int64)
        for x, u in zip(g, use):
            key = key * (CLASSES + 1) + (x + 1 if u else 0)
        out.append((mix(key.view(np.uint64)) >> U(40)).astype(np.int64) % BUCKETS)
    return out


def log_softmax(weights: np.ndarray, prior: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    x = prior + sum(weights[r] for r in rows)
    x -= x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def train_weights(train: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets, classes) and log class prior, fitted to all training tokens.

    The features see classes only, so a (context, class) pair enters by its count: one shuffle of counts over all
    tokens, then steps in which tasks sum gradients over contexts. Contexts are at most CLASSES ** 3, whatever the
    corpus. A context is written for each part of the weight table in which it has features (at most six), so that a part is summed where
    it is owned, and what the driver gets is the table's size however many tasks there are.
    """
    size = CLASSES**4

    def pairs(batches):
        held, n = [], 0

        def done():
            cell, k = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cell // CLASSES), pa.array(cell % CLASSES), pa.array(k)], ["context", "class", "n"])

        for batch in _slices(batches):
            v, at = _lists(batch.column("codes"))
            own = classes[v]
            held.append(contexts(own, at) * CLASSES + own)
            n += len(v)
            if n > 4_000_000:
                yield done()
                held, n = [], 0
        if held:
            yield done()

    assert size < 2**62
    counted = train.select("codes").mapInArrow(pairs, "context long, class long, n long").groupBy("context", "class").agg(F.sum("n").alias("n"))
    cells = counted.groupBy("context").agg(F.collect_list(F.struct("class", "n")).alias("cells")).select("context", F.col("cells.class").alias("class"), F.col("cells.n").alias("n"))

    def spread(batches):
        """A row for each part that a context has features in; the first of them is marked."""
        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.sort(np.stack(feature_rows(batch.column("context").to_numpy())) // OWNED, axis=0)
            new = np.diff(part, axis=0, prepend=-1) > 0
            nth, at = np.nonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(part[new].astype(np.int32)), pa.array(nth == 0), *batch.take(pa.array(at)).columns], ["part", "first", "context", "class", "n"])

    table = keep(cells.mapInArrow(spread, "part int, first boolean, context long, class array<long>, n array<long>").repartition(-(-BUCKETS // OWNED), "part"), "contexts")
    prior = np.full(CLASSES, 0.5)
    for k, n in table.filter("first").select(F.explode(F.arrays_zip("class", "n")).alias("x")).groupBy("x.class").agg(F.sum("x.n")).collect():
        prior[k] += n
    prior = np.log(prior / prior.sum())
    weights = np.zeros((BUCKETS, CLASSES), np.float32)

    def sums(weights_of):
        """Sums over contexts, by table row and class: of observed counts, or of those that the weights expect."""

        def add(batches):
            weights, total, met = weights_of() if weights_of else None, np.zeros((BUCKETS, CLASSES), np.float32), set()
            for batch in batches:
                if not batch.num_rows:
                    continue
                part = batch.column("part").to_numpy()
                met.update(np.unique(part).tolist())
                rows = feature_rows(batch.column("context").to_numpy())
                k, at = _lists(batch.column("class"))
                x = np.zeros((batch.num_rows, CLASSES), np.float32)
                x[np.repeat(np.arange(batch.num_rows), np.diff(at)), k] = batch.column("n").flatten().to_numpy()
                if weights is not None:
                    x = np.exp(log_softmax(weights, prior, rows)) * x.sum(1, keepdims=True)
                for r in rows:
                    own = np.flatnonzero(r // OWNED == part)
                    by = own[np.argsort(r[own], kind="stable")]
                    first = np.flatnonzero(np.diff(r[by], prepend=-1))
                    if len(by):
                        total[r[by][first]] += np.add.reduceat(x[by], first)
            for i in met:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i * OWNED : (i + 1) * OWNED].tobytes()], pa.binary())], ["part", "total"])

        total = np.zeros((BUCKETS, CLASSES))
        for i, part in table.mapInArrow(add, "part int, total binary").collect():
            total[i * OWNED : (i + 1) * OWNED] += np.frombuffer(part, np.float32).reshape(-1, CLASSES)
        return total

    seen = sums(None)
    for _ in range(STEPS):
        sent = table.sparkSession.sparkContext.broadcast(weights)
        wanted = sums(lambda: sent.value)  # noqa: B023
        sent.destroy()
        # a gradient step scaled by the expected counts, with a weak pull to zero
        step = (seen - wanted - 0.1 * weights) / (np.maximum(seen, wanted) + 2.0)
        weights = (weights + (2.0 / len(FEATURES)) * step).astype(np.float32)
    return weights, prior


def _keys(w1: np.ndarray, w2: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """One number for each word before a token; a word with many tokens after it has one for each shard of the words before it."""
    n = shards[np.where(w1 < len(shards), w1, 0)]
    return mix((w1.astype(np.uint64) << U(32)) + mix(w2.astype(np.uint64)) % n)


def word_step(n: np.ndarray, expected: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The step along each weight's own gradient, n - expected * exp(step) - pull * (weight + step), to where it vanishes (three Newton steps)."""
    expected = np.maximum(expected, 1e-12)
    step = np.log((n + WORD_PULL) / expected)
    for _ in range(3):
        grown = expected * np.exp(step)
        step += (n - grown - WORD_PULL * (weight + step)) / (grown + WORD_PULL)
    return step


def fit_words(key, w2, w, own, q, train) -> np.ndarray:
    """log10 of p(word | class, words before) less that of the word's share ``q`` of its class, for each token.

    p(w | c, h) = q(w) * exp(a[w1, w] + b[w2, w1, w]) / Z(c, h): bigram and trigram features of words, with the softmax over the words of the class. Tokens
    are sorted by ``key`` (the word before), ``w2`` (the one before it) and ``w`` and hold all tokens of their keys. Features that training
    tokens have are fitted by gradient steps, others weigh nothing, so Z is one plus a sum over features that were seen.
    """
    change = np.ones((3, len(key)), bool)
    change[0, 1:] = key[1:] != key[:-1]
    change[1, 1:] = change[0, 1:] | (w2[1:] != w2[:-1])
    change[2, 1:] = change[1, 1:] | (w[1:] != w[:-1])
    tri = np.cumsum(change[2]) - 1  # trigram of each token
    at = np.flatnonzero(change[2])
    word, pair = np.cumsum(change[0])[at] - 1, np.cumsum(change[1])[at] - 1
    own, q = own[at].astype(np.int64), q[at]
    # bigrams of trigrams; (pair, class) and (word, class) that softmaxes are over
    _, of_b, bi = np.unique((word.astype(np.uint64) << U(32)) + w[at], return_index=True, return_inverse=True)
    pairs, ctx = np.unique(pair * 256 + own, return_inverse=True)
    _, first = np.unique(ctx, return_index=True)
    before, ctx_own = np.unique((word * 256 + own)[first], return_inverse=True)
    bi_own = ctx_own[ctx[of_b]]
    n3 = np.bincount(tri[train], minlength=len(at)).astype(float)
    n2 = np.bincount(bi, n3, len(of_b))
    total = np.bincount(ctx, n3, len(pairs))
    q2 = q[of_b]
    a, b = np.zeros(len(of_b)), np.zeros(len(at))
    on2, on3 = n2 > 0, n3 > 0

    def norms():
        ea, eb = np.exp(a), np.exp(b)
        z1 = 1 + np.bincount(bi_own, q2 * (ea - 1), len(before))
        share = (q2 * ea)[bi]
        z = z1[ctx_own] + np.bincount(ctx, share * (eb - 1), len(pairs))
        return ea, eb, z1, z, share

    for _ in range(WORD_STEPS):
        ea, eb, _, z, share = norms()
        rate = total / z
        expected3 = share * eb * rate[ctx]
        expected2 = q2 * ea * np.bincount(ctx_own, rate, len(before))[bi_own] + np.bincount(bi, share * (eb - 1) * rate[ctx], len(of_b))
        a[on2] += WORD_RATE * word_step(n2[on2], expected2[on2], a[on2])
        b[on3] += WORD_RATE * word_step(n3[on3], expected3[on3], b[on3])
    _, _, _, z, _ = norms()
    return ((a[bi] + b - np.log(z[ctx])) / np.log(10))[tri]


def word_gains(documents: DataFrame, classes: np.ndarray, often: np.ndarray, within: np.ndarray, tokens: int) -> DataFrame:
    """row, gain: what the word features add to the score of each document.

    All features hold the word before a token, so tokens are dealt by it: each task owns the weights of its features, fits
    them and scores with them, and the weights grow with the corpus and never leave the tasks. Tokens travel as packed arrays, and so do gains.
    A word with more than :data:`FIT` training tokens after it is dealt into shards by the word before it, and has weights in each.
    Tokens that are alone in their class are left out: their share of it is one.
    """
    spark = documents.sparkSession
    parts = -(-tokens * 7 // 6 // DEAL) or 1
    back = -(-documents.count() // ROWS) or 1
    shards = np.ones(len(often) + 2, np.uint64)
    shards[1 : len(often) + 1] = -(-often // FIT)
    sent = spark.sparkContext.broadcast((classes, shards, (10.0 ** np.minimum(within, 0)).astype(np.float32)))

    def packed(part: np.ndarray, columns: list[np.ndarray]):
        """Batches (part, n, blob): rows by part, each blob the columns one after the other, the first one (numbers of documents) as differences."""
        by = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[by], prepend=-1)).tolist()
        ids, ns, blobs = [], [], []
        for i, j in zip(cuts, [*cuts[1:], len(by)]):
            o = by[i:j]
            ids.append(int(part[o[0]]))
            ns.append(j - i)
            blobs.append(pa.compress(b"".join([np.diff(columns[0][o], prepend=0).tobytes(), *(c[o].tobytes() for c in columns[1:])]), codec="zstd", asbytes=True))
        for i in range(0, len(ids), 64):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 64], pa.int64()), pa.array(ns[i : i + 64], pa.int64()), pa.array(blobs[i : i + 64], pa.binary())], ["part", "n", "blob"])

    def unpacked(batches, types, fold=None):
        """The columns of each part in turn; rows come sorted by part. ``fold`` makes less of the rows of a part whenever many are held."""
        width, held, size, last = 8 + sum(np.dtype(t).itemsize for t in types), [], 0, None
        for batch in batches:
            for part, n, blob in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("blob")):
                if part != last and held:
                    yield [np.concatenate(x) for x in zip(*held)]
                    held, size = [], 0
                last = part
                raw, at, columns = pa.decompress(blob.as_buffer(), decompressed_size=width * n, codec="zstd", asbytes=True), 8 * n, []
                for t in types:
                    columns.append(np.frombuffer(raw, t, n, at))
                    at += n * np.dtype(t).itemsize
                held.append([np.cumsum(np.frombuffer(raw, np.int64, n)), *columns])
                size += n
                if fold and size > FOLD:
                    held, size = [fold(*(np.concatenate(x) for x in zip(*held)))], 0
        if held:
            yield [np.concatenate(x) for x in zip(*held)]

    def deal(batches):
        classes, shards, share = sent.value
        unknown = len(classes) - 1
        held, size = [], 0

        def done():
            row, w1, w2, w, train = (np.concatenate(x) for x in zip(*held))
            return packed((_keys(w1, w2, shards) % U(parts)).astype(np.int64), [row, w1, w2, w, train])

        for batch in _slices(batches):
            v, at = _lists(batch.column("codes"))
            w = v.astype(np.uint32)
            w[v == unknown] = (mix(batch.column("tails").flatten().to_numpy().view(np.uint64)) >> U(33)).astype(np.uint32) | np.uint32(1 << 31)
            n = np.diff(at)
            place = np.arange(len(v)) - np.repeat(at[:-1], n)
            before = []
            for k in (1, 2):
                x = np.zeros(len(v), np.uint32)
                x[k:] = w[:-k]
                x[place < k] = 0
                before.append(x)
            ok = (place > 0) & (share[v] < 1)
            train = ~np.repeat(batch.column("held_out").to_numpy(zero_copy_only=False), n)
            held.append([np.repeat(batch.column("row").to_numpy(), n)[ok], before[0][ok], before[1][ok], w[ok], train[ok]])
            size += int(ok.sum())
            if size > 1_000_000:
                yield from done()
                held, size = [], 0
        if size:
            yield from done()

    def fit(batches):
        classes, shards, share = sent.value
        rest = len(classes) - 1
        for row, w1, w2, w, train in unpacked(batches, (np.uint32, np.uint32, np.uint32, np.bool_)):
            key = _keys(w1, w2, shards)
            by = np.lexsort((w, w2, key))
            key, w2, w, row, train = (x[by] for x in (key, w2, w, row, train))
            starts = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(key)]
            code = np.minimum(w, rest).astype(np.int64)
            gain, a = np.zeros(len(key)), 0
            for k, b in enumerate(starts[1:], 2):
                if k == len(starts) or starts[k] - a > 50_000:
                    gain[a:b] = fit_words(key[a:b], w2[a:b], w[a:b], classes[code[a:b]], share[code[a:b]].astype(float), train[a:b])
                    a = b
            rows, gain = summed(row, gain)
            yield from packed((mix(rows.view(np.uint64)) % U(back)).astype(np.int64), [rows, gain])
            del row, w1, w2, w, train, key, by, code, gain, rows  # before the next part is read
            pa.default_memory_pool().release_unused()

    def summed(row, gain):
        rows, at = np.unique(row, return_inverse=True)
        return [rows, np.bincount(at, gain)]

    def add(batches):
        for row, gain in unpacked(batches, (np.float64,), summed):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(row, gain)], ["row", "gain"])

    blobs = "part long, n long, blob binary"
    by_part = lambda df, n: df.repartition(min(n, MOST_TASKS), "part").sortWithinPartitions("part")
    dealt = by_part(documents.select("row", "held_out", "codes", "tails").mapInArrow(deal, blobs), parts)
    return keep(by_part(dealt.mapInArrow(fit, blobs), back).mapInArrow(add, "row long, gain double"), "gains")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out; the others train. Tokens are words (split at ASCII white
    space, A-Z lower-cased) and one end. ``base_score``: add-one unigram, log10. ``score``: log10 of
    p(class | three classes before) * p(word | class, two words before); ``gain_per_token``: what it is over the base. Words beyond the :data:`HEAD` most
    frequent ones form one class, all with one share of it (one more for all unknown words), and have word features of their own like others.
    Their counts, for the base, come by a join with the counts of the whole corpus; only sums per document return.

    Null text: empty, the end alone. Very long texts count whole. Null id: trains. Repeated ids: a row each. With no training documents every word is
    unknown. An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("held_out", held)
    counts = keep(word_counts(rows.filter(~held)), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    words = counts.filter(F.col("h") != int(END))
    top = words.filter(F.col("c") >= head_count(words, HEAD)).toArrow().sort_by([("c", "descending"), ("h", "ascending")])
    head, often = top["h"].to_numpy(), top["c"].to_numpy()
    n_end = total and (counts.filter(F.col("h") == int(END)).select("c").first() or [0])[0]
    documents = keep(coded(rows, head), "coded")
    train = documents.filter("NOT held_out")
    classes = word_classes(train, len(head))
    weights, prior = train_weights(train, classes)
    # log10 of count + 1, and of the word's share of its class; the rest's shares come by the join
    count = np.concatenate([[n_end], often, [0]]).astype(float)
    of_class = np.maximum(np.bincount(classes[:-1], count[:-1], CLASSES), 1e-9)
    plus_one = np.log10(count + 1)
    plus_one[-1] = 0.0
    within = np.log10(np.maximum(count, 1e-9)) - np.log10(of_class[classes])
    if not total:
        within[0] = 0.0  # the end is all there is in its class
    rest_words = distinct - len(head) - (n_end > 0)
    within[-1] = -np.log10(rest_words + 1)
    every = np.arange(CLASSES**3)
    table = np.concatenate([(log_softmax(weights, prior, feature_rows(part)) / np.log(10)).astype(np.float32) for part in np.array_split(every, 16)])
    sent = spark.sparkContext.broadcast((table, classes, plus_one, within))

    def score(batches):
        table, classes, plus_one, within = sent.value
        for batch in _slices(batches):
            v, at = _lists(batch.column("codes"))
            own = classes[v]
            logs = table[contexts(own, at), own].astype(np.float64) + within[v]
            unknown = len(classes) - 1
            per = lambda x: np.add.reduceat(x, at[:-1])  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(at).astype(np.int64)), pa.array(per(((v != unknown) & ((v > 0) | (plus_one[0] > 0))).astype(np.int64))), pa.array(per(plus_one[v])), pa.array(per(logs))],
                ["row", "doc_id", "held_out", "n_tokens", "known", "plus", "logs"],
            )

    scored = documents.select("row", "doc_id", "held_out", "codes").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, known long, plus double, logs double")
    rest = documents.select("row", F.explode("tails").alias("h")).join(counts, "h").groupBy("row").agg(F.count(F.lit(1)).alias("rest_known"), F.sum(F.log10(F.col("c") + 1)).alias("rest_plus"))
    gains = word_gains(documents, classes, often, within, int(total))
    joined = scored.join(rest, "row", "left").join(gains, "row", "left").na.fill(0, ["rest_known", "rest_plus", "gain"])
    base = F.col("plus") + F.col("rest_plus") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    score = F.col("logs") + F.col("gain")
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("rest_known")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), ((score - base) / F.col("n_tokens")).alias("gain_per_token"))


def op7_maxent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
