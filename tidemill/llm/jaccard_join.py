"""Exact Jaccard self-join of documents on word shingles.

Two sets of sizes n and m with 100 * |intersection| >= percent * |union| share at least percent * (n + m) / (100 + percent)
elements. Documents are put into bands by set size. All shingles have one order: rare ones before frequent ones (by
counters over all documents), then by hash. If two sets share o elements, then the first n - o + 1 of the one and the first m - o + 1
of the other, in that order, have one in common. A tile is a band and such a shingle; a set is in the tiles of its own band and,
if it can be linked to sets there, of the next. Within tiles a pair must first pass the bound that hashed bitmaps give (bits
set on one side only count elements missing on the other), then the exact intersection of
its sorted arrays. Candidates by tiles lose no link: there is no sampling or probability in it
beyond 64-bit hashes standing for shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, free_name, join_hot, keep, numbered, send_if_small, text_of
from .graph import components
from .shingles import U, mix, shingle_sets
from .tokens import in_chunks

#: Members of a group of tiles that are compared at once.
BLOCK = 512

#: Members of a tile that a task passes on; of more it passes on the smallest, with their star pairs.
LOCAL = 64

#: Counters that shingles are dealt to by hash, for their order alone, and the rows that a task sends them in.
COUNTERS, SLICES = 1 << 20, 64

#: Pairs of one document beyond which they are dealt into parts for joins.
STAR = 10_000

_DIGESTS = "doc_id long, n long, s1 long, s2 long, slice int, counts binary"
_TILES = "doc_id long, n long, s1 long, s2 long, bits binary, tiles array<long>"


def tile_bands(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, elements) for each band where a set of ``n`` elements has tiles: its first ``elements`` stand for it there."""
    if 100 * n < percent * (n + 1):
        return []  # linked to equal sets only
    ratio = 0.008 * percent
    low, band = 1, 0
    while (high := max(low, int(low / ratio))) < n:
        low, band = high + 1, band + 1
    least = lambda m: n + 1 + (-percent * (n + m)) // (100 + percent)
    found = [(band, least(-(-percent * n // 100)))]
    if 100 * n >= percent * (high + 1):
        found.append((band + 1, least(high + 1)))
    return found


_bands: dict = {}


def tiles_of(h: np.ndarray, seen: np.ndarray, percent: int) -> np.ndarray:
    if (len(h), percent) not in _bands:
        if len(_bands) > 100_000:
            _bands.clear()
        _bands[len(h), percent] = tile_bands(len(h), percent)
    bands = _bands[len(h), percent]
    if not bands:
        return np.zeros(0, np.uint64)
    first = h[np.lexsort((h, seen[counter_of(h)]))[: max(m for _, m in bands)]]
    return np.concatenate([mix(first[:m] ^ mix(np.array([band + 1], np.uint64))) for band, m in bands])


def counter_of(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def bits_of(h: np.ndarray) -> bytes:
    """A hashed bitmap of four to eight bits for every element."""
    size = min(max(64, 1 << (4 * len(h) - 1).bit_length()), 65536)
    field = np.zeros(size, bool)
    field[(h & U(size - 1)).astype(np.int64)] = True
    return np.packbits(field).tobytes()


def overlap_bound(n1, n2, b1: bytes, b2: bytes) -> int:
    """The most elements that two sets can share, from their bitmaps."""
    x, y = np.frombuffer(b1, np.uint8), np.frombuffer(b2, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n1 - int(np.bitwise_count(x & ~y).sum()), n2 - int(np.bitwise_count(y & ~x).sum()))


def linked(shared, n1, n2, percent: int):
    return 100 * shared >= percent * (n1 + n2 - shared)


def _digests(ids, sets: list[np.ndarray]) -> list[pa.Array]:
    digest = lambda key: pa.array(np.array([mix(h ^ key).sum() for h in sets], np.uint64).view(np.int64))
    return [ids, pa.array([len(h) for h in sets], pa.int64()), digest(U(0x2545F4914F6CDD1D)), digest(U(0x1234567887654321))]


def digest_table(docs: DataFrame, width: int) -> DataFrame:
    """A row per document with size and digests of its set, and for each task :data:`SLICES` rows with its counts of shingles."""

    def build(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], width)
                total += np.bincount(counter_of(np.concatenate(sets)), minlength=COUNTERS)
                yield pa.RecordBatch.from_arrays([*_digests(batch.column("doc_id").slice(a, b - a), sets), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], ["doc_id", "n", "s1", "s2", "slice", "counts"])
        if total.any():
            blobs = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in total.reshape(SLICES, -1)]
            nulls = [pa.nulls(SLICES, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "n", "s1", "s2", "slice", "counts"])

    return docs.mapInArrow(build, _DIGESTS)


def shingle_counts(digests: DataFrame) -> np.ndarray:
    """The counters of all tasks summed up, first in the tasks that read them and then by slice: :data:`COUNTERS` numbers whatever the corpus."""
    size = COUNTERS // SLICES
    read = lambda blob: np.frombuffer(pa.decompress(blob, decompressed_size=8 * size, codec="zstd", asbytes=True), np.int64)

    def add(batches):
        held: dict = {}
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                held[k] = held.get(k, 0) + read(blob)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in held.values()], pa.binary())], ["slice", "counts"])

    rows = digests.filter("slice IS NOT NULL").select("slice", "counts").mapInArrow(add, "slice int, counts binary")
    out = np.zeros((SLICES, size), np.int64)
    for k, blob in rows.repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect():
        out[k] = read(bytes(blob))
    return np.minimum(out.reshape(-1), 2**32 - 1).astype(np.uint32)


def tile_table(docs: DataFrame, width: int, percent: int, seen: np.ndarray) -> DataFrame:
    """A row per document that has shingles: size and digests of its set, bitmap and tiles."""
    sent = docs.sparkSession.sparkContext.broadcast(seen)

    def build(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], width)
                some = np.array([k for k, h in enumerate(sets) if len(h)], np.int64)
                sets = [sets[k] for k in some]
                tiles = [tiles_of(h, sent.value, percent) for h in sets]
                offsets = np.cumsum([0, *map(len, tiles)])
                flat = np.concatenate([np.zeros(0, np.uint64), *tiles]).view(np.int64)
                columns = [*_digests(batch.column("doc_id").slice(a, b - a).take(pa.array(some)), sets), pa.array([bits_of(h) for h in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s1", "s2", "bits", "tiles"])

    return docs.mapInArrow(build, _TILES)


def _runs(tile: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns.values()], list(columns))


_MET = "kind int, a long, b long"
PAIR, MEMBER, HEAVY = 0, 1, 2


def meet_in_tiles(sets: DataFrame) -> DataFrame:
    """What documents have in common by tiles: rows (kind, a, b).

    PAIR: the smallest member a of a tile and another one b. MEMBER: tile a of three or more members, and its member b.
    HEAVY: tile a, of which not all members were passed on. A task that holds more than :data:`LOCAL` members
    of a tile pairs them with the smallest itself and passes only that one on, so no tile gathers a large share of the rows.
    """

    def rows_of(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    def collapse(batches):
        def done(tiles, ids):
            tile, doc = np.concatenate(tiles), np.concatenate(ids)
            by = np.lexsort((doc, tile))
            tile, doc = tile[by], doc[by]
            at = _runs(tile)
            m = np.diff(np.append(at, len(tile)))
            large = np.repeat(m > LOCAL, m)
            lead = np.repeat(doc[at], m)
            first = np.zeros(len(tile), bool)
            first[at] = True
            on = ~large | first
            yield _table(tile=tile[on], doc=doc[on], lead=np.where(large, -2, -1)[on])
            own = large & ~first
            if own.any():
                pairs = np.unique(np.stack([lead[own], doc[own]]), axis=1)
                yield _table(tile=mix(mix(pairs[0].view(np.uint64)) + pairs[1].view(np.uint64)).view(np.int64), doc=pairs[1], lead=pairs[0])

        tiles, ids, size = [], [], 0
        for batch in batches:
            x = batch.column("tiles")
            n = np.diff(np.asarray(x.offsets))
            tiles.append(x.flatten().to_numpy())
            ids.append(np.repeat(batch.column("doc_id").to_numpy(), n))
            size += len(tiles[-1])
            if size > 1_000_000:
                yield from done(tiles, ids)
                tiles, ids, size = [], [], 0
        if size:
            yield from done(tiles, ids)

    def meet(batches):
        held = [np.zeros(0, np.int64)] * 3

        def done(tile, doc, flag):
            at = _runs(tile)
            m = np.diff(np.append(at, len(tile)))
            lead, many = np.repeat(doc[at], m), np.repeat(m > 2, m)
            heavy = np.unique(tile[flag == -2])
            found = np.stack([lead, doc])[:, lead != doc]
            found = np.unique(found, axis=1) if found.shape[1] else found
            yield rows_of(PAIR, found[0], found[1])
            yield rows_of(MEMBER, tile[many], doc[many])
            yield rows_of(HEAVY, heavy, heavy)

        for batch in batches:
            tile, doc, flag = (batch.column(c).to_numpy() for c in ("tile", "doc", "lead"))
            pair = flag >= 0
            if pair.any():
                yield rows_of(PAIR, flag[pair], doc[pair])
            tile, doc, flag = (np.concatenate([h, x[~pair]]) for h, x in zip(held, (tile, doc, flag)))
            if not len(tile):
                continue
            cut = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on
            held = [tile[cut:], doc[cut:], flag[cut:]]
            yield from done(tile[:cut], doc[:cut], flag[:cut])
        yield from done(*held)

    rows = sets.select("doc_id", "tiles").mapInArrow(collapse, "tile long, doc long, lead long")
    return rows.repartition("tile").sortWithinPartitions("tile", "doc").mapInArrow(meet, _MET)


def plausible(pairs: DataFrame, single: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and bitmaps allow a link."""

    def check(batches):
        for batch in batches:
            n1, n2, b1, b2 = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))
            ok = [linked(overlap_bound(m, n, x, y), m, n, percent) for m, n, x, y in zip(n1, n2, b1, b2)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda c: single.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    fit = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    sized = join_hot(pairs, of("a").drop("bits_a"), "a", ["b"], most=STAR).join(of("b").drop("bits_b"), "b").filter(fit)
    sized = keep(sized.select("a", "b", "n_a", "n_b"), "sized")
    right = sized.join(of("b"), ["b", "n_b"])
    return join_hot(right, of("a").withColumnRenamed("n_a", "m_a"), "a", ["b"], most=STAR).filter("n_a = m_a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(check, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The written pairs whose sets, built anew from the whole texts, are linked. Pairs of one document are dealt into parts, each with its text."""

    def check(batches):
        known = (None, None)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            first, second = batch.column("text_a"), batch.column("text_b")
            good = []
            for k in range(len(a)):
                text = first[k].as_py()
                if known[0] != text:
                    known = (text, shingle_sets([text], width)[0])
                x, y = known[1], shingle_sets([second[k].as_py()], width)[0]
                if not len(x) or not len(y):
                    good.append(False)
                    continue
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                good.append(linked(shared, len(x), len(y), percent))
            yield _table(a=np.array(a, np.int64)[good], b=np.array(b, np.int64)[good])

    sent = send_if_small(pairs)
    right = docs.join(sent, docs["doc_id"] == sent["b"]).select("a", "b", F.col("text").alias("text_b"))
    heads = send_if_small(keep(pairs.select("a").distinct(), "heads"))
    left = docs.join(heads, docs["doc_id"] == heads["a"]).select("a", F.col("text").alias("text_a"))
    parts = keep(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).filter("m > 256").select("a", F.ceil(F.col("m") / 256).cast("int").alias("parts")), "parts")
    if not parts.isEmpty():
        # a star's head goes to each part of its pairs
        many = F.coalesce("parts", F.lit(1))
        parts = send_if_small(parts)
        right = right.join(parts, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), many).cast("int")).drop("parts")
        left = left.join(parts, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), many - 1))).drop("parts")
        return keep(right.join(left, ["a", "part"]).select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), name)
    return keep(right.join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), name)


def matrix(bits: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Bitmaps as rows of words, the larger ones folded to the smallest size."""
    width = int(sizes.min())
    out = np.empty((len(bits), width), np.uint8)
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        own = np.frombuffer(b"".join([bits[k] for k in of]), np.uint8).reshape(len(of), size // width, width)
        out[of] = np.bitwise_or.reduce(own, axis=1)
    return out.view(np.uint64)


def bitmap_pairs(rows: dict, bits: np.ndarray, percent: int, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Documents of all row pairs of different components, and of different blocks where there are two, whose bitmaps allow a link.

    ``best``: of each document the pair alone that shares most by its bound.
    """
    m, n = len(bits), rows["n"]
    lacks = np.empty((m, m), np.int64)
    step = max(1, 1_000_000 // (m * bits.shape[1]))
    for k in range(0, m, step):
        lacks[k : k + step] = np.bitwise_count(bits[k : k + step, None] & ~bits[None]).sum(2, dtype=np.int64)
    bound = np.minimum(n[:, None] - lacks, n[None] - lacks.T)
    ok = linked(bound, n[:, None], n[None], percent) & (rows["component"][:, None] != rows["component"][None])
    if rows["lo"][0] != rows["hi"][0]:
        ok &= rows["own"][:, None] != rows["own"][None]
    if best:
        i = np.flatnonzero(ok.any(1))
        j = np.where(ok, bound, -1)[i].argmax(1)
    else:
        i, j = np.nonzero(np.triu(ok, 1))
    return rows["doc"][i], rows["doc"][j]


def block_pairs(members: DataFrame, percent: int, best: bool = False) -> DataFrame:
    """Pairs of members of one group of tiles but of different components that their bitmaps let pass; ``best``: of each member one for each block it meets.

    A group's members are dealt into blocks of about :data:`BLOCK`; a task compares two blocks at once.
    """
    sizes = keep(members.groupBy("tile").agg(F.count(F.lit(1)).alias("m")), "sizes")
    dealt = members.join(send_if_small(sizes), "tile").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tile", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc", "component", "n", "bits")

    def compare(batches):
        names = ("tile", "lo", "hi", "doc", "component", "n", "own")

        def done(column, bits):
            key = np.stack([column["tile"], column["lo"], column["hi"]])
            at = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))), key.shape[1]) if key.shape[1] else [0]
            sizes = np.fromiter(map(len, bits), np.int64, len(bits))
            left, right = [], []
            for i, j in zip(at[:-1], at[1:]):
                if j - i > 1:
                    part = {c: column[c][i:j] for c in names}
                    x, y = bitmap_pairs(part, matrix(bits[i:j], sizes[i:j]), percent, best)
                    left.append(x)
                    right.append(y)
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield _table(a=np.minimum(a, b), b=np.maximum(a, b))

        held, bits = {c: np.zeros(0, np.int64) for c in names}, []
        for batch in batches:
            if not batch.num_rows:
                continue
            held = {c: np.concatenate([held[c], batch.column(c).to_numpy().astype(np.int64)]) for c in names}
            bits = bits + batch.column("bits").to_pylist()
            last = [held[c][-1] for c in names[:3]]
            cut = int(np.argmax(np.all([held[c] == x for c, x in zip(names[:3], last)], axis=0)))  # the last blocks may go on
            yield from done({c: x[:cut] for c, x in held.items()}, bits[:cut])
            held, bits = {c: x[cut:] for c, x in held.items()}, bits[cut:]
        yield from done(held, bits)

    return dealt.repartition("tile", "lo", "hi").sortWithinPartitions("tile", "lo", "hi").mapInArrow(compare, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every document.

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct
    shingles of ``width`` words (words split at ASCII white space, A-Z lower-cased).
    ``class_id``: the smallest id with the same set; ``component_id``: the smallest reachable by links.
    Every link between different sets is in the result's components. In each tile the smallest member is paired with the
    others; pairs that bitmaps allow are verified. Two other members of a tile are either in one group that such pairs connect,
    and are compared there once if their components still differ, or in two groups, and are compared within the tile.

    Null, empty or wordless text: an empty set, linked with nothing. A text of fewer than ``width``
    words is one shingle. Very long texts are read whole; their bitmaps grow to 8 KB, then bounds get looser, not wrong.
    Null ids: returned with a null component, linked with nothing. Rows that share an id are one
    document for links; equal texts under different ids are linked. An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    known = rows.filter("doc_id IS NOT NULL")
    digests = keep(digest_table(rows, width), "digests")
    seen = shingle_counts(digests)
    sets = digests.filter("doc_id IS NOT NULL AND n > 0").select("doc_id", "n", "s1", "s2")
    classes = keep(sets.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    ids = keep(join_hot(sets, classes, ["s1", "s2", "n"], ["doc_id"]), "ids")
    # of equal sets the smallest id alone goes on
    copies = keep(ids.filter("doc_id != rep").select("doc_id", "s1", "s2").distinct(), "copies")
    single = keep(tile_table(known, width, percent, seen).join(send_if_small(copies), ["doc_id", "s1", "s2"], "left_anti").select("doc_id", "n", "bits", "tiles"), "tiles")
    drop(classes, copies)
    met = keep(meet_in_tiles(single), "met")
    pairs = keep(met.filter(F.col("kind") == PAIR).select("a", "b").distinct(), "pairs")
    fair = keep(plausible(pairs, single, percent), "fair")

    def across(found: DataFrame, labels: DataFrame) -> DataFrame:
        of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        named = join_hot(found, of("a"), "a", ["b"], "left", STAR).join(of("b"), "b", "left")
        return named.filter("coalesce(c_a, a) != coalesce(c_b, b)").select("a", "b")

    first = keep(fair.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links = verified(known, first, width, percent, "links")
    labels = components(links)
    rest = keep(across(fair, labels).join(first, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(verified(known, rest, width, percent, "links"))
        labels = components(links)
    drop(first, rest)
    groups, tested = components(fair), pairs
    # the best pair of each member connects most of what belongs together, so that few pairs are left when all that stay apart are compared
    for best in (True, False):
        more = _within_groups(groups, labels, single, percent, best).unionByName(_within_tiles(met, single, groups, percent, best))
        more = keep(across(more.distinct().join(tested, ["a", "b"], "left_anti"), labels), "more")
        if more.isEmpty():  # the best pairs may all have been tested, others not
            continue
        links = links.unionByName(verified(known, keep(plausible(more, single, percent), "fair"), width, percent, "links"))
        labels, tested = components(links), tested.unionByName(more)
        if best:
            groups = components(fair.select("a", "b").unionByName(links))
    drop(met, pairs, fair, single)
    of_class = labels.withColumnRenamed("node", "rep")
    final = join_hot(ids, of_class, "rep", ["doc_id"], "left").select("doc_id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    final = final.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
    out = digests.filter("slice IS NULL").select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def _within_groups(groups: DataFrame, labels: DataFrame, single: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs that their bitmaps let pass, between components within groups that plausible star pairs connect."""
    named = groups.select(F.col("node").alias("doc"), F.col("component").alias("tile")).join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    named = keep(named, "named")
    apart = keep(named.groupBy("tile").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("m > 2 AND c1 != c2").select("tile"), "apart")
    members = named.join(send_if_small(apart), "tile", "left_semi").join(single.select(F.col("doc_id").alias("doc"), "n", "bits"), "doc")
    return block_pairs(keep(members, "members"), percent, best)


def _within_tiles(met: DataFrame, single: DataFrame, groups: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs that their bitmaps let pass, between groups within a tile.

    Members of a tile that are all in one group are compared there. Other tiles are put together by their member of
    least hash, which tiles of much the same members share, so a pair that shares many tiles is compared few times.
    """
    members = met.filter(F.col("kind") == MEMBER).select(F.col("a").alias("tile"), F.col("b").alias("doc"))
    heavy = keep(met.filter(F.col("kind") == HEAVY).select(F.col("a").alias("tile")).distinct(), "heavy")
    if not heavy.isEmpty():
        every = single.select(F.col("doc_id").alias("doc"), F.explode("tiles").alias("tile")).join(send_if_small(heavy), "tile", "left_semi").select("tile", "doc")
        members = members.join(send_if_small(heavy), "tile", "left_anti").unionByName(every)
    named = members.join(groups.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    named = keep(named.select("tile", "doc", "component"), "tile-members")
    apart = named.groupBy("tile").agg(F.min_by("doc", F.xxhash64("doc")).alias("head"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 != c2")
    heads = keep(apart.select("tile", "head"), "tile-heads")
    clusters = named.join(send_if_small(heads), "tile").select(F.col("head").alias("tile"), "doc", "component").distinct()
    mixed = keep(clusters.join(single.select(F.col("doc_id").alias("doc"), "n", "bits"), "doc"), "mixed")
    return block_pairs(mixed, percent, best)


def distinct_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group that links connect, with its own columns: the one of the smallest id (null ids last), of rows with equal ids one.

    Rows are told apart by a number written with them, so copies with null or equal ids are copies like others.
    Null, empty and wordless texts are linked with nothing, so all of them stay. Very long texts count whole. An empty table gives no rows. Columns
    of any name are carried and clash with nothing.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    found = jaccard_components(rows.select(F.col(row).alias("doc_id"), F.col("text")), width, percent).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"))
    placed = keep(found.join(rows.select(F.col(row).alias("row"), place.alias("place")), "row"), "placed")
    first = keep(placed.groupBy("component").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("component", F.col("first.row").alias("first")), "first")
    others = keep(join_hot(placed, first, "component", ["row"]).filter("row != first").select(F.col("row").alias(row)), "others")
    drop(placed, first)
    return rows.join(send_if_small(others), row, "left_anti").drop(row)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
