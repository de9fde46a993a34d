"""Exact Jaccard join of documents by their word n-grams, as a metric-space join.

The Jaccard distance of shingle sets is a metric.  Two facts of it do the work:

* A single shingle is a pivot; a document's nearest pivots are its own
  shingles, all equally near.  The tie is broken by one global order (shingles
  known to be frequent last, then by hash), and a document goes to the regions
  of the first of them: as many as a document within the threshold could lack,
  and one more.  Documents within the threshold then share a region, and the
  places of the shared shingle in both bound the distance from below.
* A histogram of a set's hashes has an L1 distance that never exceeds the size
  of the symmetric difference.  It gives exact lower bounds from small sketches,
  and is itself a metric.  Regions of many documents pick document pivots,
  build Voronoi cells around them in this metric, copy documents of the window
  that the triangle inequality leaves open into the neighbouring cells, and
  join the cells recursively.

Pairs that no bound excludes are verified on the whole sets.  Documents whose
sets are equal are one point.  Links that can't change any component are not
followed: in a large region documents are linked to a few pivots first, and
only pairs of different components are joined exactly afterwards.  No sample,
cap or chance decides what is found; which shingles are known to be frequent
affects the speed alone.

Defined cases: null and empty texts have no shingles and link with nothing;
texts of fewer words than n are one shingle; rows that repeat an id are judged
each by its own text; a null id gets a null component and is not a component's
smallest id; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.components import components
from matchlake.llm.kernels import LOWER, flat, joined, mix, shingle_sets, stream, tidy, tidy_group
from matchlake.llm.tables import bounded, partitions, saved

WORDS, NEED = 5, 75  # shingle length; links: 100 * intersection >= NEED * union
FREQUENT = 1 << 19  # at most so many shingles are held as frequent: 8 MB
GROUP, HELD = 1 << 19, 1 << 21  # words per pass; shingles that a task counts together
SMALL, LEAF, BLOCK = 8, 64, 2048  # documents of a region, and of a cell, whose pairs are all looked at; documents per block
PIVOTS, STARS, FIRST = 8, 3, 3  # cells per level; documents that others are first linked to; pairs tried first
SPLIT = 512  # pairs that share one copy of a document's set
_SEED = stream(1, 9)
_U = np.uint64


def _sets(data: np.ndarray, at: np.ndarray, group: int):
    """Groups of whole documents: (first document, their shingle sets)."""
    words, off = LOWER.hashes(data, at)
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + group, "right")) - 1)
        yield lo, shingle_sets(words[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], WORDS)
        lo = hi


def signature(s: np.ndarray) -> int:
    """A content key of a set, as a signed 64-bit integer."""
    return int(mix(mix(s ^ _SEED).sum(keepdims=True) + _U(len(s))).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Histogram of the hashes, about one cell per two of them, counts up to 255."""
    cells = 16
    while cells < min(len(s) // 2, 1 << 14):
        cells *= 2
    return np.minimum(np.bincount((s & _U(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def _folded(raw: bytes, cells: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).astype(np.int32)
    while len(x) > cells:
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    return x


def difference(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of linked sets of n and m elements."""
    return (n + m) - 2 * overlap(n, m)


def overlap(n, m):
    """The smallest intersection of linked sets of n and m elements."""
    return -((-NEED * (n + m)) // (100 + NEED))


def may_link(raw_a: bytes, n: int, raw_b: bytes, m: int) -> bool:
    """The sketches don't exclude a link."""
    if 100 * min(n, m) < NEED * max(n, m):
        return False
    cells = min(len(raw_a), len(raw_b))
    return int(np.abs(_folded(raw_a, cells) - _folded(raw_b, cells)).sum()) <= difference(n, m)


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, sig, sketch) of each document; n = 0: the other columns are null."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def run(batches):
        for b in batches:
            n, one, raw = [], [], []
            for _, sets in _sets(*flat(b.column(text)), GROUP):
                for s in sets:
                    n.append(len(s))
                    one.append(signature(s) if len(s) else None)
                    raw.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(raw, pa.binary())], names=schema.names)

    return docs.select(key, text).mapInArrow(tidy(run), schema)


def _distinct(sets: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """The different sets among these, with their signatures."""
    return list({signature(s): s for s in sets if len(s)}.items())


def frequent(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of shingles that a task met in several documents at once: the most frequent, at most FREQUENT.

    Only the order of shingles depends on it, no result.
    """

    def met(seen: dict[int, np.ndarray]) -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(list(seen.values())), return_counts=True)
        m = c > 1
        return pa.RecordBatch.from_arrays([pa.array(u[m].view(np.int64)), pa.array(c[m])], names=["shingle", "docs"])

    def run(batches):
        seen, held = {}, 0
        for b in batches:
            for _, sets in _sets(*flat(b.column(text)), GROUP):
                for k, s in _distinct(sets):
                    if k not in seen:
                        seen[k] = s
                        held += len(s)
                if held >= HELD:
                    yield met(seen)
                    seen, held = {}, 0
        if seen:
            yield met(seen)

    counts = saved(docs.select(text).mapInArrow(tidy(run), "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs")))
    steps = counts.groupBy(F.floor(F.log2("docs") * 8).alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in steps:
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.where(F.floor(F.log2("docs") * 8) >= least).toArrow()
    h = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], top.column("docs").to_numpy()[order]


def regions(sets: list[np.ndarray], hot: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles in the global order of each set: (shingle, set's number, place)."""
    size = np.array([len(s) for s in sets])
    window = size - overlap_alone(size) + 1
    every = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), size)
    base = np.cumsum(size) - size
    rare = np.ones(len(every), bool)
    place = np.minimum(np.searchsorted(hot, every), max(0, len(hot) - 1))
    if len(hot):
        rare = hot[place] != every
    rank = np.cumsum(rare) - 1
    rank -= np.append(0, np.cumsum(rare))[base][of]
    take = rare & (rank < window[of])
    out = [(every[take], of[take], rank[take])]
    rares = np.add.reduceat(rare.astype(np.int64), base)
    for k in np.flatnonzero(rares < window):
        a, z = base[k], base[k] + size[k]
        common = np.flatnonzero(~rare[a:z]) + a
        common = common[np.lexsort((every[common], docs[place[common]]))][: window[k] - rares[k]]
        out.append((every[common], np.full(len(common), k), rares[k] + np.arange(len(common))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def overlap_alone(n):
    """The smallest intersection that a set of n elements has with any linked set."""
    return -((-NEED * n) // 100)


def _in_cell(sig, n, place) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a small region that neither sizes nor places exclude."""
    i, j = np.triu_indices(len(sig), 1)
    return _possible(sig, n, place, i, j)


def _possible(sig, n, place, i, j):
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    left = np.minimum(n[i] - place[i], n[j] - place[j])  # of the intersection, if the region's shingle is the first common one
    good = (sig[i] != sig[j]) & ((large >= 65535) | ((100 * small >= NEED * large) & (left >= overlap(n[i], n[j]))))
    a, b = sig[i][good], sig[j][good]
    return np.minimum(a, b), np.maximum(a, b)


def _candidates(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """(region, a, b, place): pairs of signatures (region null), and (region, a, place) members of larger regions."""
    hot, count = frequent(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast((hot, count))
    names = ["hash", "sig", "n", "place"]

    def emit(batches):
        hot, count = shared.value
        for b in batches:
            for _, sets in _sets(*flat(b.column(text)), GROUP):
                every = _distinct(sets)
                if not every:
                    continue
                sig = np.array([k for k, _ in every], np.int64)
                n = np.minimum(65535, [len(s) for _, s in every]).astype(np.uint16)
                h, of, place = regions([s for _, s in every], hot, count)
                bucket = (h % _U(buckets)).astype(np.int32)
                h = mix(h).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
                rows = {x: [] for x in names}
                for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist(), strict=True):
                    k = order[lo:hi]
                    for x, v in zip(names, (h[k], sig[of[k]], n[of[k]], np.minimum(65535, place[k]).astype(np.uint16)), strict=True):
                        rows[x].append(v.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cut], pa.int32()), *(pa.array(rows[x], pa.binary()) for x in names)], names=["bucket", *names])

    def meet(table: pa.Table) -> pa.Table:
        read = lambda x, kind: joined(table.column(x), kind)
        h, sig, n, place = read("hash", np.uint32), read("sig", np.int64), read("n", np.uint16).astype(np.int64), read("place", np.uint16).astype(np.int64)
        order = np.lexsort((sig, h))
        h, sig, n, place = h[order], sig[order], n[order], place[order]
        new = np.append(True, (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]))[: len(h)]
        h, sig, n, place = h[new], sig[new], n[new], place[new]
        cut = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        size = np.diff(np.append(cut, len(h)))
        two = cut[size == 2]
        pairs, large = [_possible(sig, n, place, two, two + 1)], {}
        for c, m in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if m <= SMALL:
                pairs.append(_in_cell(sig[c : c + m], n[c : c + m], place[c : c + m]))
            else:
                member = sig[c : c + m]
                for k in range(STARS):  # documents of middling size, spread over it
                    hub = c + np.argsort(n[c : c + m], kind="stable")[min(m // 2 + k, m - 1)]
                    pairs.append(_possible(sig, n, place, np.full(m, hub), np.arange(c, c + m)))
                name = int(mix(mix(member.view(np.uint64)).sum(keepdims=True)).view(np.int64)[0])  # regions of the same documents are one
                large[name] = (member, np.minimum(place[c : c + m], large[name][1]) if name in large else place[c : c + m])
        found = np.unique(np.column_stack([np.concatenate(x) for x in zip(*pairs, strict=True)]), axis=0) if pairs else np.zeros((0, 2), np.int64)
        region = np.repeat(np.array(list(large), np.int64), [len(x) for x, _ in large.values()]) if large else np.zeros(0, np.int64)
        member = np.concatenate([x for x, _ in large.values()]) if large else np.zeros(0, np.int64)
        first = np.concatenate([x for _, x in large.values()]) if large else np.zeros(0, np.int64)
        none, k = pa.nulls(len(found), pa.int64()), len(region)
        return pa.table({"region": pa.concat_arrays([none, pa.array(region)]), "a": pa.array(np.concatenate((found[:, 0], member))), "b": pa.concat_arrays([pa.array(found[:, 1].copy()), pa.nulls(k, pa.int64())]), "place": pa.concat_arrays([none, pa.array(first)])})

    dealt = docs.select(text).mapInArrow(tidy(emit), "bucket int, hash binary, sig binary, n binary, place binary")
    return dealt.groupBy("bucket").applyInArrow(tidy_group(meet), "region long, a long, b long, place long")


def paired(pairs: DataFrame, points: DataFrame, *names: str) -> DataFrame:
    """Pairs (a, b) of signatures with columns of both points, as name_a and name_b.

    A point of more than SPLIT pairs has as many copies as it needs, and its pairs are dealt to them.
    """
    count = pairs.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").count().where(F.col("count") > SPLIT)
    heavy = bounded(saved(count.select("sig", F.ceil(F.col("count") / SPLIT).cast("int").alias("parts"))))
    copies = points.select("sig", *names).join(heavy, "sig", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))

    def beside(rows, own, other):
        rows = rows.join(heavy.withColumnRenamed("sig", own), own, "left")
        rows = rows.withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        return rows.join(copies.select(F.col("sig").alias(own), "part", *(F.col(x).alias(f"{x}_{own}") for x in names)), [own, "part"]).drop("part")

    return beside(beside(pairs, "a", "b"), "b", "a")


def _bounded_pairs(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches don't exclude a link."""

    def run(batches):
        for b in batches:
            c = [b.column(x).to_pylist() for x in ("sketch_a", "n_a", "sketch_b", "n_b")]
            yield b.filter(pa.array([may_link(*x) for x in zip(*c, strict=True)], pa.bool_())).select(["a", "b"])

    return paired(pairs, points, "n", "sketch").mapInArrow(tidy(run), "a long, b long")


def _cells(x: np.ndarray, reach: int, members: np.ndarray, small: int, depth: int = 0):
    """Voronoi cells of histograms around pivots, each with its window's documents: (members, own) arrays.

    Of two histograms within `reach`, one is at home in a cell that the other
    is in too: if p is nearest to u and q to v, then
    |v - p| <= |u - p| + reach <= |u - q| + reach <= |v - q| + 2 * reach.
    """
    if len(members) <= small or depth == 6:
        yield members, np.ones(len(members), bool)
        return
    rows = x[members]
    pivots, far = [0], np.abs(rows - rows[0]).sum(1)
    while len(pivots) < PIVOTS and far.max() > 0:
        pivots.append(int(far.argmax()))
        far = np.minimum(far, np.abs(rows - rows[pivots[-1]]).sum(1))
    to = np.stack([np.abs(rows - rows[p]).sum(1) for p in pivots])
    home = to.argmin(0)
    inside = to <= to.min(0) + 2 * reach
    for k in range(len(pivots)):
        within = np.flatnonzero(inside[k])
        if len(within) > 0.8 * len(members):
            yield members[within], home[within] == k
        else:
            for deeper, own in _cells(x, reach, members[within], small, depth + 1):
                mine = np.isin(deeper, members[home == k])
                yield deeper, own & mine


def _members(large: DataFrame, points: DataFrame, classes: DataFrame, first: bool) -> DataFrame:
    """Candidate pairs (a, b) of different classes in larger regions: the FIRST nearest of each two classes of a block, or all."""
    rows = large.join(classes.select(F.col("node").alias("a"), F.col("root").alias("class")), "a", "left").withColumn("class", F.coalesce("class", "a"))
    sized = rows.groupBy("region").agg(F.count("*").alias("size"), (F.min("class") < F.max("class")).alias("mixed")).where("mixed").drop("mixed")
    rows = rows.join(sized, "region").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    # each two blocks meet once: a block is sent to itself and to every other block
    rows = rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("region", "a", "place", "class", F.col("block").alias("own"), F.least("block", "mate").alias("block"), F.greatest("block", "mate").alias("other"))
    rows = rows.join(points.select(F.col("sig").alias("a"), "n", "sketch"), "a")

    def join(table: pa.Table) -> pa.Table:
        sig, n, own, place = (table.column(c).to_numpy() for c in ("a", "n", "own", "place"))
        raw, kind = table.column("sketch").to_pylist(), table.column("class").to_numpy()
        block, other = table.column("block")[0].as_py(), table.column("other")[0].as_py()
        out_a, out_b, near = [], [], []
        order = np.argsort(n)
        sig, n, own, kind, raw = sig[order], n[order], own[order], kind[order], [raw[k] for k in order]
        left = n - place[order]  # bounds the intersection of a pair whose first common shingle is the region's
        lo = 0
        while lo < len(n):  # rings of sizes: a document, and those of up to 100 / NEED of its size
            ring = np.flatnonzero((n >= n[lo]) & (100 * n[lo] * 100 >= NEED * NEED * n))
            home = n[ring] * NEED <= 100 * n[lo]
            cells = min(len(raw[k]) for k in ring)
            x = np.stack([_folded(raw[k], cells) for k in ring])
            reach = 2 * int(n[ring].max()) * (100 - NEED) // (100 + NEED)
            for members, mine in _cells(x, reach, np.arange(len(ring)), LEAF):
                for k in members[mine].tolist():
                    rest = members[members != k]
                    rest = rest[(home[k] | home[rest]) & (kind[ring[rest]] != kind[ring[k]])]
                    if other != block:
                        rest = rest[own[ring[rest]] != own[ring[k]]]
                    if not len(rest):
                        continue
                    gap = np.abs(x[rest] - x[k]).sum(1)
                    m, nk = n[ring[rest]], int(n[ring[k]])
                    good = (gap <= difference(m, nk)) & (100 * np.minimum(m, nk) >= NEED * np.maximum(m, nk)) & (np.minimum(left[ring[rest]], left[ring[k]]) >= overlap(m, nk))
                    out_a.append(np.full(good.sum(), ring[k]))
                    out_b.append(ring[rest[good]])
                    near.append(gap[good] / (m[good] + nk))
            lo = int(np.searchsorted(n, 100 * n[lo] // NEED, "right"))
        if not out_a:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j, d = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(near)
        if first and len(i):
            pair = np.column_stack((np.minimum(kind[i], kind[j]), np.maximum(kind[i], kind[j])))
            best = np.lexsort((d, pair[:, 1], pair[:, 0]))
            new = np.append(True, (np.diff(pair[best], axis=0) != 0).any(1))
            start = np.flatnonzero(new)
            rank = np.arange(len(best)) - np.repeat(start, np.diff(np.append(start, len(best))))
            i, j = i[best[rank < FIRST]], j[best[rank < FIRST]]
        a, b = np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])
        found = np.unique(np.column_stack((a, b)), axis=0)
        return pa.table({"a": pa.array(found[:, 0].copy()), "b": pa.array(found[:, 1].copy())})

    return rows.groupBy("region", "block", "other").applyInArrow(join, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, points: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of signatures whose whole sets link."""
    wanted = pairs.select("a").union(pairs.select("b")).distinct().join(points.select(F.col("sig").alias("a"), "rep"), "a")
    texts = docs.select(F.col(key).alias("rep"), F.col(text).alias("whole")).join(bounded(saved(wanted)), "rep")

    def build(batches):
        for b in batches:
            sig = b.column("a").to_pylist()
            for lo, sets in _sets(*flat(b.column("whole")), GROUP):
                mine = [(sig[lo + k], s.tobytes()) for k, s in enumerate(sets) if len(s) and signature(s) == sig[lo + k]]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in mine], pa.int64()), pa.array([s for _, s in mine], pa.binary())], names=["sig", "items"])

    sets = saved(texts.select("a", "whole").mapInArrow(tidy(build), "sig long, items binary").dropDuplicates(["sig"]))

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("items_a").to_pylist(), b.column("items_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= NEED * (len(x) + len(y) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return paired(pairs, sets, "items").mapInArrow(tidy(run), "a long, b long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles and component_id (the smallest key that links reach)."""
    spark = docs.sparkSession
    docs = docs.select(key, text)
    rows = saved(described(docs, key, text))
    points = saved(rows.where("n > 0").groupBy("sig").agg(F.min(key).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).where("rep is not null"))
    met = saved(_candidates(docs.where(F.col(key).isNotNull()), text, 2 * partitions(spark)))
    large = met.where("region is not null").groupBy("region", "a").agg(F.min("place").alias("place"))
    tested = saved(_bounded_pairs(saved(met.where("region is null").select("a", "b").distinct()), points))
    links = saved(verified(tested, docs, points, key, text))
    if large.limit(1).count():
        for first in (True, False):
            more = saved(_members(large, points, components(links), first).distinct().join(tested, ["a", "b"], "left_anti"))
            if more.limit(1).count():
                links = saved(links.union(verified(more, docs, points, key, text)))
                tested = tested.union(more)
    classes = components(links)
    reps = classes.join(points.select(F.col("sig").alias("node"), "rep"), "node")
    roots = reps.groupBy("root").agg(F.min("rep").alias("component"))
    named = reps.join(roots, "root").select(F.col("node").alias("sig"), "component")
    every = points.select("sig", "rep").join(named, "sig", "left").select("sig", F.coalesce("component", "rep").alias("component"))
    out = rows.select(key, "n", F.coalesce("sig", F.xxhash64(key)).alias("sig"), F.col("sig").isNotNull().alias("has")).join(every, "sig", "left")
    component = F.when(F.col("has") & F.col(key).isNotNull(), F.coalesce("component", key)).otherwise(F.col(key))
    return out.select(key, F.col("n").alias("n_shingles"), component.alias("component_id"))
