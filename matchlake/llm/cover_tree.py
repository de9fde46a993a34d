"""Exact near-duplicate vectors by dual traversal of cover trees.

Directions of vectors are points of the unit sphere, where cosine >= t means a
chord of at most sqrt(2 - 2 t).  Equal vectors are one point with a count.
Points are dealt to blocks around far-apart pivots, and blocks that are too
large to blocks around pivots of their own, level by level (what no pivots
divide, by hash).  In each block nested nets with halving radii, down to where
no two points share a centre, form a cover tree, kept as each point's
ancestors.  Pairs of blocks, then pairs of tree nodes, are pruned if their
centres are further apart than the chord and both covering radii; surviving
pairs of points are compared by matrix products in single precision, and those
near the threshold again in double precision.

A block pair gives link counts per point and a spanning forest of its links,
never the links themselves, so dense groups don't multiply.  The pruning is as
good as the data's intrinsic dimension lets it be: points in general position
in many dimensions are all about equally far apart, no exact metric method
prunes them, and the work is then quadratic in the different vectors (spread
evenly over block pairs).

Defined cases: null and zero vectors and those with null or non-finite
components have no links and are their own component; vectors of different
lengths are never linked; rows that repeat an id with different vectors are
points of their own, the id's rows each get their vector's links; null ids
take no part and keep a null component; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.components import components
from matchlake.llm.tables import bounded, saved

LINK = 0.95
#: Different vectors per block; blocks of the first level; rows of its pivots' sample; pivots of a divided block and rows of their sample.
BLOCK, MOST, SAMPLE, SPLIT, PART = 4096, 1024, 8192, 16, 256
#: Net radii, halving; finer ones are not needed for chords of links. The one from which finer ones are tried.
RADII = (1 / 64, 1 / 32, 1 / 16, 0.125, 0.25, 0.5, 1.0)
USUAL = 0.25
_STRIP, _EPS = 512, 1e-4


def directions(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision, from lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Points further apart than radius that cover all others within it, and each point's centre among them."""
    bar = 1 - radius * radius / 2
    centres: list[int] = []
    mine = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 256):
        part = x[lo : lo + 256]
        free = np.ones(len(part), bool)
        if centres:
            s = part @ x[centres].T
            mine[lo : lo + 256] = s.argmax(1)
            free = s.max(1) < bar
        open_ = np.flatnonzero(free)
        s = part[open_] @ part[open_].T
        done = np.zeros(len(open_), bool)
        for k in range(len(open_)):
            if not done[k]:
                take = ~done & (s[k] >= bar)
                take[k] = True
                mine[lo + open_[take]] = len(centres)
                done |= take
                centres.append(lo + int(open_[k]))
    return np.array(centres, np.int64), mine


def tree(x: np.ndarray) -> np.ndarray:
    """Ancestors of each point by level, finest first: (levels, points) indices of points. Below the first level that groups anything all points are their own."""
    every, k = np.arange(len(x)), RADII.index(USUAL)
    finest = net(x, USUAL)
    while k and len(finest[0]) < len(x):
        finer = net(x, RADII[k - 1])
        if len(finer[0]) == len(x):
            break
        finest, k = finer, k - 1
    out, points, up = [], every, every
    for n, radius in enumerate(RADII):
        if n >= k:
            centres, mine = finest if n == k else net(x[points], radius)
            up = points[centres][mine[np.searchsorted(points, up)]]
            points = points[centres]
        out.append(up)
    return np.array(out)


def levels(x: np.ndarray, up: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(centres, covering radii, each point's centre) from coarse to fine, without levels that hardly group."""
    found, finer = [], len(x)
    for ancestors in up:
        centres, mine = np.unique(ancestors, return_inverse=True)
        if len(centres) <= 0.5 * finer:
            far = np.sqrt(np.maximum(0, 2 - 2 * (x * x[ancestors]).sum(1))) + 1e-6
            radius = np.zeros(len(centres))
            np.maximum.at(radius, mine, far)
            found.append((centres, radius, mine))
            finer = len(centres)
    return found[::-1]


def _open_pairs(y: np.ndarray, a: np.ndarray, b: np.ndarray, la: list, lb: list, chord: float, told: list[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(open, ma, mb): which pairs of the finest nodes can hold a link, and the node of each point.

    From the coarsest level down, only children of pairs that are still open are looked at.
    """
    open_, ma, mb = np.ones((1, 1), bool), np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    depth = min(len(la), len(lb))
    for (ca, ra, na), (cb, rb, nb) in zip(la[len(la) - depth :], lb[len(lb) - depth :], strict=True):
        up_a, up_b = ma[ca], mb[cb]
        near = np.zeros((len(ca), len(cb)), bool)
        for node in np.unique(up_a).tolist():
            rows, cols = np.flatnonzero(up_a == node), np.flatnonzero(open_[node][up_b])
            if len(cols):
                s = y[a[ca[rows]]] @ y[b[cb[cols]]].T
                near[np.ix_(rows, cols)] = np.sqrt(np.maximum(0, 2 - 2 * s)) <= chord + ra[rows, None] + rb[None, cols] + 2e-3
                if told is not None:
                    told[0] += s.size
        open_, ma, mb = near, na, nb
    return open_, ma, mb


def traverse(x: np.ndarray, a: np.ndarray, b: np.ndarray, up: np.ndarray, weight: np.ndarray, link: float, told: list[int] | None = None):
    """Link counts of all points and local component labels, over pairs of a point of a and one of b.

    a, b: indices of points, equal or disjoint.  up: ancestors as indices of points.
    Points of a are taken node by node, with the points of those nodes of b that
    are open for it; where most pairs are open, in strips of several nodes.
    told: a list whose first number grows by the products computed.
    """
    chord = math.sqrt(max(0.0, 2 - 2 * link))
    y = x.astype(np.float32)
    open_, ma, mb = _open_pairs(y, a, b, levels(x[a], np.searchsorted(a, up[:, a])), levels(x[b], np.searchsorted(b, up[:, b])), chord, told)
    count, label = np.zeros(len(x), np.int64), np.arange(len(x))
    same = len(a) == len(b) and (a == b).all()
    order = np.argsort(ma, kind="stable")
    dense = open_.mean() > 0.5
    cuts = np.arange(0, len(a), _STRIP) if dense else np.flatnonzero(np.diff(ma[order], prepend=-1))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)], strict=True):
        at = order[lo:hi]
        some = np.flatnonzero(open_[ma[at[0]]][mb]) if not dense else np.arange(len(b))
        if not len(some):
            continue
        rows, cols = a[at], b[some]
        s = y[rows] @ y[cols].T
        if told is not None:
            told[0] += s.size
        i, j = np.nonzero(s >= link - _EPS)
        close = s[i, j] < link + _EPS
        if close.any():
            exact = (x[rows[i[close]]] * x[cols[j[close]]]).sum(1)
            bad = np.flatnonzero(close)[exact < link]
            keep = np.ones(len(i), bool)
            keep[bad] = False
            i, j = i[keep], j[keep]
        i, j = rows[i], cols[j]
        if same:
            i, j = i[i != j], j[i != j]
        count += np.bincount(i, weight[j], len(x)).astype(np.int64)
        if not same:
            count += np.bincount(j, weight[i], len(x)).astype(np.int64)
        label = _merged(label, i, j)
    return count, label


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links i-j: the smallest index of each local component."""
    while len(i):
        p, q = label[i], label[j]
        open_ = p != q
        if not open_.any():
            break
        i, j, p, q = i[open_], j[open_], p[open_], q[open_]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(p, q), np.minimum(p, q))
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        label = to[label]
    return label


def spread(x: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` far-apart ones of these directions."""
    chosen, best = [0], x @ x[0]
    while len(chosen) < min(count, len(x)) and best.min() < 1 - 1e-12:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    return x[chosen]


def _pivots(points: DataFrame, dim: int, blocks: int) -> np.ndarray:
    """Far-apart directions among the SAMPLE points of least hash: centres of blocks."""
    rows = points.where(F.col("dim") == dim).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").toArrow()
    return spread(directions(rows.column("vector")), blocks)


def _placed(points: DataFrame, pivots: dict[int, tuple[int, np.ndarray]], by: str) -> DataFrame:
    """points with `home`, that of the nearest pivot: pivots has the first home and the directions for each value of the column `by`; other values keep their home."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)
    kept = [f for f in points.schema.fields if f.name != "home"]

    def place(batches):
        for b in batches:
            of = b.column(by).to_numpy()
            out = b.column("home").to_numpy().copy() if "home" in b.schema.names else np.zeros(len(b), np.int32)
            for value in np.unique(of).tolist():
                if value in shared.value:
                    at = np.flatnonzero(of == value)
                    begin, those = shared.value[value]
                    out[at] = begin + (directions(b.column("vector").take(pa.array(at))) @ those.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(out.astype(np.int32))], names=[*(f.name for f in kept), "home"])

    return points.mapInArrow(place, T.StructType([*kept, T.StructField("home", T.IntegerType())]))


def _divided(homes: DataFrame, first: int) -> DataFrame:
    """homes with `block`: homes of over 2 * BLOCK points are divided around pivots of their own until none is left; what pivots don't divide is divided by hash."""
    homes, given, whole = saved(homes), {}, {}
    while True:
        sizes = {r["home"]: r["count"] for r in homes.groupBy("home").count().collect()}
        for home, (parent, size) in given.items():
            if sizes.get(home, 0) > 0.8 * size:  # its pivots hardly divide it
                whole[home] = parent
        large = [h for h, n in sizes.items() if n > 2 * BLOCK and h not in whole]
        if not large:
            break
        some = homes.where(F.col("home").isin(large)).withColumn("_n", F.row_number().over(Window.partitionBy("home").orderBy(F.xxhash64("node"), "node"))).where(F.col("_n") <= PART)

        def chosen(t: pa.Table) -> pa.Table:
            x = spread(directions(t.column("vector")), SPLIT)
            return pa.table({"home": pa.array([t.column("home")[0].as_py()] * len(x), pa.int32()), "pivot": pa.array(x.tolist())})

        found: dict[int, list] = {}
        for r in some.select("home", "vector").groupBy("home").applyInArrow(chosen, "home int, pivot array<double>").collect():
            found.setdefault(r["home"], []).append(r["pivot"])
        pivots, given = {}, {}
        for home, those in sorted(found.items()):
            pivots[home] = (first, np.array(those))
            given |= {first + k: (home, sizes[home]) for k in range(len(those))}
            first += len(those)
        homes = saved(_placed(homes, pivots, "home"))
    begin, total = {}, 0
    for h, n in sorted(sizes.items()):
        begin[h] = (total, -(-n // (2 * BLOCK)) if h in whole else 1)
        total += begin[h][1]
    spark = homes.sparkSession
    table = spark.createDataFrame([(h, a, n) for h, (a, n) in begin.items()], "home int, _first int, _parts int")
    return homes.join(bounded(table), "home").withColumn("block", F.col("_first") + F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")).drop("home", "_first", "_parts")


def _usable(vector: str):
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda c: c != 0)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", link: float = LINK) -> DataFrame:
    """One row per vector: key, n_links (other vectors linked directly), component_id and kept."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), F.when(_usable(vector) & F.col(key).isNotNull(), F.col(vector)).alias("_vector"))
    points = saved(rows.where("_vector is not null").groupBy(F.col("_vector").alias("vector")).agg(F.min("_key").alias("node"), F.count("*").alias("copies")).withColumn("dim", F.size("vector")))
    sizes = {r["dim"]: r["count"] for r in points.groupBy("dim").count().collect()}
    plans, first = {}, 0
    for dim, size in sorted(sizes.items()):
        pivots = _pivots(points, dim, min(MOST, -(-size // BLOCK)))
        plans[dim] = (first, pivots)
        first += len(pivots)
    if not plans:
        return rows.select(F.col("_key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"), F.lit(True).alias("kept"))
    kind = points.schema["node"].dataType
    blocks = _divided(_placed(points, plans, "dim"), first)
    grown = T.StructType([*blocks.schema.fields, T.StructField("up", T.ArrayType(T.IntegerType())), T.StructField("at", T.IntegerType())])

    def grow(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("node").to_numpy(zero_copy_only=False), kind="stable")
        t = t.take(pa.array(order))
        up = tree(directions(t.column("vector")))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, up.size + 1, len(up)), pa.int32()), pa.array(up.T.ravel().astype(np.int32)))
        return t.append_column("up", lists).append_column("at", pa.array(np.arange(len(t)), pa.int32()))

    trees = saved(blocks.groupBy("block").applyInArrow(grow, grown))

    def radius(t: pa.Table) -> pa.Table:
        x = directions(t.column("vector"))
        centre = x.mean(0)
        far = float(np.sqrt(((x - centre) ** 2).sum(1).max())) + 1e-9
        return pa.table({"block": t.column("block").slice(0, 1), "dim": t.column("dim").slice(0, 1), "centre": pa.array([centre.tolist()]), "far": [far]})

    found = saved(trees.select("block", "dim", "vector").groupBy("block").applyInArrow(radius, "block int, dim int, centre array<double>, far double"))
    balls = found.toArrow()
    chord = math.sqrt(max(0.0, 2 - 2 * link)) + 1e-6
    of = {d: balls.filter(pc.equal(balls.column("dim"), d)) for d in sizes}
    shared = spark.sparkContext.broadcast({d: (t.column("block").to_numpy(), t.column("centre").combine_chunks().flatten().to_numpy().reshape(len(t), -1), t.column("far").to_numpy()) for d, t in of.items()})

    def near(batches):
        """Each block's pairs with itself and with the blocks whose balls come within the chord, named by both."""
        for b in batches:
            names, pairs = [], []
            for me, dim, centre, far in zip(*(b.column(c).to_pylist() for c in ("block", "dim", "centre", "far")), strict=True):
                block, c, f = shared.value[dim]
                for other in block[np.sqrt(((c - np.array(centre)) ** 2).sum(1)) <= chord + f + far].tolist():
                    names.append(me)
                    pairs.append((min(me, other) << 31) + max(me, other))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(pairs, pa.int64())], names=["block", "pair"])

    pairs = saved(found.repartition(spark.sparkContext.defaultParallelism).mapInArrow(near, "block int, pair long"))
    joined = trees.join(bounded(pairs), "block").select("pair", "block", "node", "copies", "vector", "up", "at")
    out = T.StructType([T.StructField("node", kind), T.StructField("links", T.LongType()), T.StructField("root", kind)])

    def meet(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("at").to_numpy(), t.column("block").to_numpy()))
        t = t.take(pa.array(order))
        block, node, weight = (t.column(c).to_numpy(zero_copy_only=False) for c in ("block", "node", "copies"))
        up = np.stack(t.column("up").to_pylist()).T
        a = np.flatnonzero(block == block[0])
        b = np.flatnonzero(block == block[-1])
        up[:, b] += b[0]
        count, label = traverse(directions(t.column("vector")), a, b, up, weight, link)
        some = np.flatnonzero(count)
        return pa.table({"node": pa.array(node[some]), "links": pa.array(count[some]), "root": pa.array(node[label[some]])}).cast(pa.schema([("node", t.schema.field("node").type), ("links", pa.int64()), ("root", t.schema.field("node").type)]))

    met = saved(joined.groupBy("pair").applyInArrow(meet, out))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    every = points.join(links, "node", "left").join(roots, "node", "left")
    every = every.select(F.col("vector").alias("_vector"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    alone = rows.where("_vector is null").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"))
    linked = rows.where("_vector is not null").join(every, "_vector").select("_key", "n_links", "component_id")
    return linked.unionByName(alone).select(F.col("_key").alias(key), "n_links", "component_id", F.col("_key").eqNullSafe(F.col("component_id")).alias("kept"))
