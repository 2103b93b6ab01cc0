"""Near-duplicate vectors by int8 tile products with error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, send_if_small
from .graph import components

#: Vectors of a tile, at most about so many; pivots that order vectors into tiles; bytes of the tiles of a group.
TILE = 4096
PIVOTS = 64
GROUP_BYTES = 16 << 20
_TILE = "tile long, n long, dim int, ids binary, sizes binary, vectors binary, center binary, radius double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers from -127 to 127 for unit vectors (rows), their scales, and the length of what each loses."""
    scale = 127 / np.abs(x).max(1)
    q = np.rint(x * scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(x - q / scale[:, None], axis=1) * (1 + 1e-9)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors; the largest component goes to one first, so that no square under- or overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def prepared(x: np.ndarray) -> tuple:
    """Unit vectors, their quantised forms, scales and what each loses."""
    u = unit(x)
    return (u, *quantise(u))


def close_pairs(x: tuple, y: tuple, threshold: float, rows: int = 512):
    """Blocks (i, j) of all row pairs of x and y (see :func:`prepared`) with cosine at or over ``threshold``.

    |x.y - p.q| <= err_x + (1 + err_x) * err_y for unit x, y and their quantised forms p, q:
    pairs whose int8 product plus that bound stays below the threshold are out for certain,
    the others are computed anew in double precision.
    """
    (ux, p, sp, ep), (uy, q, sq, eq) = x, y
    wide = q.astype(np.float32).T  # products of int8 are exact in float32 up to 1000 dimensions
    slack = 1e-5 * max(1, ux.shape[1] / 1000)
    for a in range(0, len(ux), rows):
        g = (p[a : a + rows].astype(np.float32) @ wide) / np.float32(sp[a : a + rows, None])
        g /= sq.astype(np.float32)
        e = ep[a : a + rows, None]
        least = threshold - slack - (e.max() + (1 + e.max()) * eq.max())
        i, j = np.nonzero(g >= np.float32(least))
        near = g[i, j] + e[i, 0] + (1 + e[i, 0]) * eq[j] + slack >= threshold
        i, j = i[near] + a, j[near]
        for b in range(0, len(i), 65_536):
            m, n = i[b : b + 65_536], j[b : b + 65_536]
            exact = np.einsum("ij,ij->i", ux[m], uy[n]) >= threshold
            yield m[exact], n[exact]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer than n links that join the same rows as the links (i, j) do."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            kept = np.flatnonzero(label != np.arange(n))
            return kept, label[kept]
        label = new


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding).

    Vectors are linked when their cosine, in double precision, is ``threshold`` or more. Equal vectors
    are taken together first. Others are ordered by their nearest of a bounded sample of
    pivots and cut into tiles of about :data:`TILE`, and tiles in that order into groups of at most :data:`GROUP_BYTES`. Groups meet on a
    grid, so a tile moves once for each group, not once for each tile; two tiles that meet are multiplied unless their centres are so
    far apart that no pair can be close. A product of two tiles leaves link counts and a
    spanning forest of its links, so dense groups do not write out all their pairs.

    Very large and very small components are scaled before they are squared. Null, zero or partly null or non-finite vectors link with nothing and are kept. Vectors of different lengths
    are not linked. Null ids link with nothing. Rows with equal ids are counted each. An empty table gives no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("v"))
    sound = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    keyed = rows.withColumn("ok", F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False))).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64("v", F.lit(1)))
    table = keep(keyed, "vectors")
    classes = table.filter("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v"))
    classes = keep(classes, "vector-classes")
    kind = np.float64 if "double" in dict(classes.dtypes)["v"] else np.float32
    pivots = [np.array(r[0], np.float64) for r in classes.select("v").limit(PIVOTS).collect()]

    def nearest(batches):
        for batch in batches:
            v, out = batch.column("v"), np.zeros(batch.num_rows, np.int64)
            ends = np.asarray(v.offsets)
            flat, n = v.flatten().to_numpy().astype(np.float64), np.diff(ends)
            at = np.cumsum(n) - n
            for dim in np.unique(n).tolist():
                of = np.flatnonzero(n == dim)
                own = [p for p in pivots if len(p) == dim]
                x = flat[at[of][:, None] + np.arange(dim)]
                out[of] = dim * PIVOTS + ((unit(x) @ unit(np.array(own)).T).argmax(1) if own else 0)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("size"), batch.column("v"), pa.array(out)], ["rep", "size", "v", "cell"])

    celled = keep(classes.select("rep", "size", "v").mapInArrow(nearest, f"rep long, size long, v {dict(classes.dtypes)['v']}, cell long"), "cells")
    cells = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks"))
    tiled = celled.join(F.broadcast(cells), "cell").withColumn("tile", F.col("cell") * 1_000_000 + F.pmod(F.xxhash64("rep"), F.col("blocks")))

    def gather(group: pa.Table) -> pa.Table:
        n = group.num_rows
        x = np.asarray(group.column("v").combine_chunks().flatten()).reshape(n, -1)
        u = unit(x)
        c = u.mean(0)
        c = c / (np.linalg.norm(c) or 1)
        radius = float(np.arccos(np.clip(u @ c, -1, 1)).max()) if c.any() else np.pi
        raw = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
        return pa.table([pa.array([group.column("tile")[0].as_py()]), pa.array([n]), pa.array([x.shape[1]], pa.int32()), raw(group.column("rep").to_numpy()), raw(group.column("size").to_numpy()), raw(x.astype(kind)), raw(c.astype(np.float64)), pa.array([radius])], ["tile", "n", "dim", "ids", "sizes", "vectors", "center", "radius"])

    tiles = keep(tiled.select("tile", "rep", "size", "v").groupBy("tile").applyInArrow(gather, _TILE), "tiles")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_tiles, width = tiles.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("vectors")), F.lit(1))).first()
    size = max(1, min(GROUP_BYTES // width, int(n_tiles / (2 * tasks) ** 0.5)))
    n_groups = -(-n_tiles // size)
    numbers = keep(tiles.select("tile").withColumn("group", F.expr(f"(row_number() OVER (ORDER BY tile) - 1) div {size}").cast("int")), "groups")
    met = tiles.join(send_if_small(numbers), "tile").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_groups - 1)))))
    met = met.select(F.least("group", "other").alias("lo"), F.greatest("group", "other").alias("hi"), "group", *[x.split()[0] for x in _TILE.split(", ")])

    def multiply_cell(cell: list[dict]):
        angle, ready = np.arccos(threshold), {}
        for k, one in enumerate(cell):
            for other in cell[k:]:
                if one["dim"] != other["dim"] or (one["group"] == other["group"] and one["lo"] != one["hi"]):
                    continue
                apart = np.arccos(np.clip(one["center"] @ other["center"], -1, 1))
                if apart > one["radius"] + other["radius"] + angle + 1e-6:
                    continue
                for t in (one, other):
                    if t["tile"] not in ready:
                        ready[t["tile"]] = prepared(t["vectors"])
                yield from multiply(one, other, ready[one["tile"]], ready[other["tile"]])

    def multiply(one: dict, other: dict, x: tuple, y: tuple):
        same, n, m = one is other, one["n"], other["n"]
        links, counts = [], [np.zeros(n, np.int64), np.zeros(m, np.int64)]
        for i, j in close_pairs(x, y, threshold):
            if same:
                i, j = i[i < j], j[i < j]
            counts[0] += np.bincount(i, other["sizes"][j], n).astype(np.int64)
            counts[1] += np.bincount(j, one["sizes"][i], m).astype(np.int64)
            links.append(np.stack(forest(i, j if same else j + n, n + (0 if same else m))))
        both = one["ids"] if same else np.concatenate([one["ids"], other["ids"]])
        count = counts[0] + counts[1] if same else np.concatenate(counts)
        linked = np.flatnonzero(count)
        if len(linked):
            f, t = forest(*np.concatenate(links, 1), len(both))
            a, b, c = np.concatenate([both[linked], both[f]]), np.concatenate([both[linked], both[t]]), np.concatenate([count[linked], np.zeros(len(f), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], ["a", "b", "n"])

    def cells_of(batches):
        cell: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                t = {c: batch.column(c)[k].as_py() for c in ("lo", "hi", "group", "tile", "n", "dim", "radius")}
                get = lambda c, of: np.frombuffer(batch.column(c)[k].as_py(), of)  # noqa: B023,E731
                t |= {"ids": get("ids", np.int64), "sizes": get("sizes", np.int64), "center": get("center", np.float64), "vectors": get("vectors", kind).reshape(-1, t["dim"])}
                if cell and (t["lo"], t["hi"]) != (cell[0]["lo"], cell[0]["hi"]):
                    yield from multiply_cell(cell)
                    cell = []
                cell.append(t)
        if cell:
            yield from multiply_cell(cell)

    n = min(max(1, n_groups * (n_groups + 1) // 2), 8 * tasks)
    dealt = met.repartition(n, "lo", "hi").sortWithinPartitions("lo", "hi", "tile")
    found = keep(dealt.mapInArrow(cells_of, "a long, b long, n long"), "vector-links")
    drop(celled, tiles, numbers)
    counts = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.filter("n = 0").select("a", "b")).withColumnRenamed("node", "rep")
    of = classes.select("k1", "k2", "rep", "size").join(counts, "rep", "left").join(labels, "rep", "left")
    of = of.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("ok"))
    out = table.select("vec_id", "ok", "k1", "k2").join(of, ["k1", "k2", "ok"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
