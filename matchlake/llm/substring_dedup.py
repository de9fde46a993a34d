"""Removal of repeated passages through a partitioned de Bruijn graph of words.

A window of `window` consecutive words is an edge from the node of its first
window - 1 words to the node of its last.  An edge is repeated if its words
also start anywhere else, in the same document or another.

1. *Points.*  Equal texts are one point of the weight two: their windows are
   all repeated, so the copies need nothing further, and one of them stands in
   the graph for all.
2. *Anchors.*  Of the shorter k-mers inside each window the one of the least
   hash is its anchor; it depends on the window's words alone, so repeated
   edges share it.  About a tenth of all positions are anchors.  Anchors that
   occur in one place settle all their windows as unrepeated there.
3. *Nodes and edges.*  A node lives in the bucket of its own least k-mer, and
   windows with a repeated anchor go to the buckets of both their nodes, as
   runs of neighbours.  A bucket therefore has all edges of its nodes: it finds
   the repeated ones, their in- and out-degrees at each node, and compacts
   chains through nodes of one edge in and one out to paths.
4. *Passages.*  Paths that share the edge between two buckets are joined on it,
   and chains of paths become passages (nonbranching paths of the whole graph).
5. *Source.*  Each occurrence of a path has source coordinates and a checksum
   over its edges, which the document at these coordinates has to reproduce
   before anything is removed; touching occurrences of one passage are a span.

Nothing is judged by samples: all windows of all texts take part.  What many
documents share is combined before each shuffle: a task sends one row for an
anchor or edge that it holds repeatedly and settles its own documents, so that
no bucket grows with a passage's popularity.  Different texts are shuffled
once; copies are not.

Defined cases: null and empty texts have no words; texts of fewer words than
the window keep all; repeated rows are each other's copies and lose all their
windows; rows with a null id take part as any other; other columns pass
through unchanged, also if they are called key, text_key or the like.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.components import components
from matchlake.llm.kernels import PLAIN, flat, joined, long_grams, mix, sliding_min, tidy, tidy_group
from matchlake.llm.tables import BROADCAST_ROWS, partitions, saved

WINDOW, GROUP = 35, 1 << 19
_TEXT, _KEY, _FOUND = "_dedup_text", "_dedup_key", "_dedup_found"
_U = np.uint64


def _groups(words: np.ndarray, at: np.ndarray, group: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Whole documents of about `group` words: words, offsets, first and last document."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + group, "right")) - 1)
        yield words[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lo, hi
        lo = hi


def _windows(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """k-mer hashes, each window's anchor, which windows lie in one document, and each window's document."""
    k = max(1, window // 2)
    mers = long_grams(words, k)
    anchor = sliding_min(mers, window - k + 1)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    valid = np.arange(len(anchor)) + window <= at[1:][doc]
    return mers, anchor, valid, doc


def edge_ids(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A hash of each edge, by those of its nodes."""
    return mix(u * _U(0x9E3779B97F4A7C15) + v)


def nodes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window its two nodes and their least k-mers. A window of one word has two nodes of its own."""
    if window == 1:
        return words, mix(words + _U(1)), words, words
    node = long_grams(words, window - 1)
    k = max(1, window // 2)
    home = sliding_min(long_grams(words, k), window - k)
    return node[:-1], node[1:], home[:-1], home[1:]


def _anchors(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes and their documents, one row per anchor position (all positions of equal least hashes)."""
    mers, anchor, valid, _ = _windows(words, at, window)
    if not len(anchor):
        return mers[:0], np.zeros(0, np.int64)
    span = len(mers) - len(anchor)  # the window's other k-mers
    pad = np.full(span, ~np.uint64(0))
    top = ~sliding_min(~np.concatenate((~pad, np.where(valid, anchor, np.uint64(0)), ~pad)), span + 1)
    chosen = np.flatnonzero((top == mers) & (top > 0))
    return mers[chosen], np.repeat(np.arange(len(at) - 1), np.diff(at))[chosen]


def _repeats(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur more than once, and the distinct ones that do."""
    order = np.argsort(value)
    v = value[order]
    new = np.append(True, v[1:] != v[:-1])[: len(v)]
    many = ~new
    many[:-1] |= ~new[1:]
    out = np.zeros(len(value), bool)
    out[order] = many
    return out, v[new & many]


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.append(True, b[1:] != b[:-1])[: len(b)])
    sorted_ = [c[order] for c in columns]
    for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(b)).tolist(), strict=True):
        yield int(b[lo]), [c[lo:hi] for c in sorted_]


def _packed(rows: dict[int, dict[str, np.ndarray]], names: list[str]) -> pa.RecordBatch:
    buckets = sorted(rows)
    columns = [pa.array([rows[b][n].tobytes() if n in rows[b] else b"" for b in buckets], pa.binary()) for n in names]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *columns], names=["bucket", *names])


def _binary(*names: str) -> str:
    return ", ".join(["bucket int", *(f"{n} binary" for n in names)])


_ANCHORS = ["hash", "key", "seen", "done_hash", "done_key"]
_EDGES = ["node", "run", "seen", "done_key", "done"]
#: Bits of `home`: the first node, the last node lives in the bucket.
_RUN = np.dtype([("key", "<i8"), ("at", "<u4"), ("n", "<u4"), ("home", "u1")])
_SEEN = np.dtype([("u", "<u8"), ("v", "<u8"), ("home", "u1")])
_SPAN = np.dtype([("at", "<u4"), ("n", "<u4"), ("sum", "<u8")])


def _repeated_anchors(points: DataFrame, window: int, buckets: int) -> DataFrame:
    """(key, anchors): of each point, the anchors that occur anywhere else too."""

    def emit(batches):
        for b in batches:
            words, at = PLAIN.hashes(*flat(b.column(_TEXT)))
            keys = b.column(_KEY).to_numpy(zero_copy_only=False)
            for w, o, lo, hi in _groups(words, at, GROUP):
                value, doc = _anchors(w, o, window)
                if not len(value):
                    continue
                key = keys[lo:hi][doc]
                many, distinct = _repeats(value)
                rows: dict[int, dict[str, np.ndarray]] = {}
                for n, (h, k) in _dealt((value[~many] % _U(buckets)).astype(np.int32), value[~many], key[~many]):
                    rows.setdefault(n, {}).update(hash=h, key=k)
                for n, (h,) in _dealt((distinct % _U(buckets)).astype(np.int32), distinct):
                    rows.setdefault(n, {}).update(seen=h)
                for n, (h, k) in _dealt((key[many] % buckets).astype(np.int32), value[many], key[many]):
                    rows.setdefault(n, {}).update(done_hash=h, done_key=k)
                yield _packed(rows, _ANCHORS)

    def meet(table: pa.Table) -> pa.Table:
        value, key, seen = joined(table.column("hash"), np.uint64), joined(table.column("key"), np.int64), joined(table.column("seen"), np.uint64)
        many, _ = _repeats(np.concatenate((value, seen)))
        many = many[: len(value)]
        keys = np.concatenate((key[many], joined(table.column("done_key"), np.int64)))
        hashes = np.concatenate((value[many], joined(table.column("done_hash"), np.uint64)))
        return pa.table({"key": pa.array(keys, pa.int64()), "anchor": pa.array(hashes.view(np.int64), pa.int64())})

    met = points.select(_KEY, _TEXT).mapInArrow(tidy(emit), _binary(*_ANCHORS)).groupBy("bucket").applyInArrow(tidy_group(meet), "key long, anchor long")
    return met.groupBy("key").agg(F.collect_set("anchor").alias(_FOUND))


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indices lo, lo + 1, ... of n values each, in a row."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _runs(u, v, at_u, at_v, t, d, window: int):
    """Runs of neighbouring windows by bucket: (bucket, first window, number, first and last node live there, all nodes in a row).

    u, v: the windows' nodes; at_u, at_v: the buckets of these; t, d: the
    windows' places and documents.  A run has the nodes of one bucket and the
    windows on either side of them.
    """
    new = np.append(True, (t[1:] != t[:-1] + 1) | (d[1:] != d[:-1]) | (window == 1))
    first = np.flatnonzero(new)
    stretch = np.cumsum(new) - 1
    size = np.diff(np.append(first, len(t)))
    base = first + np.arange(len(first))  # a stretch of m windows has m + 1 nodes
    every, home = np.empty(len(t) + len(first), np.uint64), np.empty(len(t) + len(first), np.int32)
    place = np.arange(len(t)) + stretch
    every[place], home[place] = u, at_u
    end = base + size
    every[end], home[end] = v[first + size - 1], at_v[first + size - 1]
    opens = np.append(True, home[1:] != home[:-1])
    opens[base] = True
    a = np.flatnonzero(opens)
    z = np.append(a[1:], len(home)) - 1
    of = np.searchsorted(base, a, "right") - 1
    lo, hi = np.maximum(a - 1, base[of]), np.minimum(z + 1, end[of])
    return home[a], lo - of, hi - lo, (lo == a) | ((hi == z).astype(np.uint8) << 1), every, lo


def chains(u: np.ndarray, v: np.ndarray, home_u: np.ndarray, home_v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct edges: the first edge of each one's path, and the edge that follows it there (-1: none).

    A path goes on through nodes that live here with one edge in and one out; a
    cycle of such nodes begins at its first edge in the given order.
    """
    n = len(u)
    names, of = np.unique(np.concatenate((u, v)), return_inverse=True)
    iu, iv = of[:n], of[n:]
    here = np.zeros(len(names), bool)
    here[iu[home_u]] = True
    here[iv[home_v]] = True
    passing = here & (np.bincount(iu, minlength=len(names)) == 1) & (np.bincount(iv, minlength=len(names)) == 1)
    out = np.zeros(len(names), np.int64)
    out[iu] = np.arange(n)
    after = np.where(passing[iv], out[iv], -1)
    before = np.full(n, -1)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)

    def climbed() -> tuple[np.ndarray, np.ndarray]:
        up, least = np.where(before >= 0, before, np.arange(n)), np.arange(n)
        for _ in range(n.bit_length() + 1):
            least, further = np.minimum(least, least[up]), up[up]
            if (further == up).all():
                break
            up = further
        return up, least

    up, least = climbed()
    lost = np.flatnonzero(before[up] >= 0)  # on cycles
    if len(lost):
        cut = np.unique(least[lost])
        after[before[cut]] = -1
        before[cut] = -1
        up, _ = climbed()
    return up, after


def _graph(points: DataFrame, window: int, buckets: int) -> DataFrame:
    """Occurrences of paths (key, at, n, sum, path; path is null where a task settled its own) and paths (path, first, last: edges that another bucket has too).

    points: with the column of repeated anchors.
    """

    def emit(batches):
        for b in batches:
            words, at = PLAIN.hashes(*flat(b.column(_TEXT)))
            keys, heavy = b.column(_KEY).to_numpy(zero_copy_only=False), b.column("many").to_numpy(zero_copy_only=False).astype(bool)
            column = b.column(_FOUND)
            found, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            ends = ends - ends[0]
            for w, o, lo, hi in _groups(words, at, GROUP):
                _, anchor, valid, doc = _windows(w, o, window)
                mine = np.unique(found[ends[lo] : ends[hi]])  # what any document of the group has: a little more than each has
                if not len(anchor) or not len(mine):
                    continue
                place = np.minimum(np.searchsorted(mine, anchor), len(mine) - 1)
                take = np.flatnonzero(valid & (mine[place] == anchor))
                if not len(take):
                    continue
                u, v, at_u, at_v = (x[take] for x in nodes(w, window))
                at_u, at_v = (at_u % _U(buckets)).astype(np.int32), (at_v % _U(buckets)).astype(np.int32)
                edge, owner, key = edge_ids(u, v), doc[take], keys[lo:hi]
                copied = heavy[lo:hi][owner]
                many = _repeats(np.concatenate((edge, edge[copied])))[0][: len(edge)]
                rows: dict[int, dict[str, np.ndarray]] = {}
                one = np.flatnonzero(many)[np.unique(edge[many], return_index=True)[1]]
                away = one[at_u[one] != at_v[one]]
                seen = np.zeros(len(one) + len(away), _SEEN)
                both = np.concatenate((one, away))
                seen["u"], seen["v"] = u[both], v[both]
                seen["home"] = np.concatenate((1 + 2 * (at_u[one] == at_v[one]), np.full(len(away), 2)))
                for n, (x,) in _dealt(np.concatenate((at_u[one], at_v[away])), seen):
                    rows.setdefault(n, {}).update(seen=x)
                own = np.flatnonzero(many & ~copied)
                if len(own):
                    t, d = take[own], owner[own]
                    first = np.flatnonzero(np.append(True, (t[1:] != t[:-1] + 1) | (d[1:] != d[:-1])))
                    span = np.zeros(len(first), _SPAN)
                    span["at"], span["n"], span["sum"] = t[first] - o[d[first]], np.diff(np.append(first, len(t))), np.add.reduceat(edge[own], first)
                    for n, (k, x) in _dealt((key[d[first]] % buckets).astype(np.int32), key[d[first]], span):
                        rows.setdefault(n, {}).update(done_key=k, done=x)
                rest = np.flatnonzero(~many)
                if len(rest):
                    t, d = take[rest], owner[rest]
                    target, at_, size, home, every, first = _runs(u[rest], v[rest], at_u[rest], at_v[rest], t, d, window)
                    run = np.zeros(len(target), _RUN)
                    run["key"], run["at"], run["n"], run["home"] = key[d[at_]], t[at_] - o[d[at_]], size, home
                    for n, (r, x, m) in _dealt(target, run, first, size):
                        rows.setdefault(n, {}).update(run=r, node=every[_ranges(x, m + 1)])
                yield _packed(rows, _EDGES)

    def meet(table: pa.Table) -> pa.Table:
        node, run, seen = joined(table.column("node"), np.uint64), joined(table.column("run"), _RUN), joined(table.column("seen"), _SEEN)
        size = run["n"].astype(np.int64)
        base = np.cumsum(size + 1) - size - 1
        at = _ranges(base, size)  # each run's windows, by their first nodes
        owner = np.repeat(np.arange(len(run)), size)
        u, v = node[at], node[at + 1]
        home_u, home_v = np.ones(len(at), bool), np.ones(len(at), bool)
        begin = np.cumsum(size) - size
        home_u[begin], home_v[begin + size - 1] = run["home"] & 1, run["home"] >> 1
        edge, known = edge_ids(u, v), edge_ids(seen["u"], seen["v"])
        many = _repeats(np.concatenate((edge, known, known)))[0][: len(edge)]
        us, vs = np.concatenate((seen["u"], u[many])), np.concatenate((seen["v"], v[many]))
        hu, hv = np.concatenate((seen["home"] & 1 > 0, home_u[many])), np.concatenate((seen["home"] & 2 > 0, home_v[many]))
        e, one = np.unique(np.concatenate((known, edge[many])), return_index=True)
        us, vs, hu, hv = us[one], vs[one], hu[one], hv[one]
        head, after = chains(us, vs, hu, hv)
        bucket = table.column("bucket")[0].as_py() if len(table) else 0
        path = mix(e[head] + _U(bucket + 1)).view(np.int64)
        tails, heads = np.flatnonzero(after < 0), np.flatnonzero(head == np.arange(len(e)))
        tails, heads = tails[np.argsort(head[tails])], heads[np.argsort(heads)]
        first, last = e[heads].view(np.int64), e[tails].view(np.int64)
        span, keys, of = np.zeros(0, _SPAN), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if many.any():
            x, d, t = edge[many], owner[many], at[many]
            r = np.searchsorted(e, x)
            cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1] + 1) | (after[r[:-1]] != r[1:])))
            span = np.zeros(len(cut), _SPAN)
            span["at"], span["n"] = run["at"][d[cut]] + t[cut] - base[d[cut]], np.diff(np.append(cut, len(x)))
            span["sum"] = np.add.reduceat(x, cut)
            keys, of = run["key"][d[cut]], path[r[cut]]
        done, done_key = joined(table.column("done"), _SPAN), joined(table.column("done_key"), np.int64)
        a, b, c = len(span), len(done), len(heads)
        full = lambda kind, *parts: pa.concat_arrays([pa.nulls(x, kind) if isinstance(x, int) else pa.array(x).cast(kind) for x in parts])
        values = {"key": full(pa.int64(), keys, done_key, c)}
        for name, kind in (("at", pa.int64()), ("n", pa.int64())):
            values[name] = full(kind, span[name].astype(np.int64), done[name].astype(np.int64), c)
        values["sum"] = full(pa.int64(), span["sum"].astype(np.uint64).view(np.int64), done["sum"].astype(np.uint64).view(np.int64), c)
        values["path"] = full(pa.int64(), of, b, path[heads])
        values["first"] = full(pa.int64(), a + b, pa.array(first, mask=hu[heads]))
        values["last"] = full(pa.int64(), a + b, pa.array(last, mask=hv[tails]))
        return pa.table(values)

    kept = points.select(_KEY, _TEXT, "many", _FOUND).mapInArrow(tidy(emit), _binary(*_EDGES))
    return kept.groupBy("bucket").applyInArrow(tidy_group(meet), "key long, at long, n long, sum long, path long, first long, last long")


def _passages(graph: DataFrame) -> DataFrame:
    """(path, passage) of the paths that go on in other buckets: each joins the one that begins with its last edge."""
    ends = graph.where("last is not null").select(F.col("path").alias("a"), F.col("last").alias("edge"))
    begins = graph.where("first is not null").select(F.col("path").alias("b"), F.col("first").alias("edge"))
    return components(ends.join(begins, "edge")).select(F.col("node").alias("path"), F.col("root").alias("passage"))


def verified(words: np.ndarray, spans: tuple[np.ndarray, ...], window: int) -> np.ndarray:
    """Which spans (at, n, sum) of one document its own edges reproduce."""
    at, n, expected = spans
    if not len(at) or len(words) < window:
        return np.zeros(len(at), bool)
    total = np.append(_U(0), np.cumsum(edge_ids(*nodes(words, window)[:2]), dtype=np.uint64))
    inside = (at >= 0) & (at + n < len(total))
    at, n = np.where(inside, at, 0), np.where(inside, n, 0)
    return inside & (total[at + n] - total[at] == expected)


def covered(words: np.ndarray, spans: tuple[np.ndarray, ...], window: int) -> np.ndarray:
    """Marks the words inside repeated windows of one document, by its verified spans."""
    at, n, _ = spans
    good = verified(words, spans, window)
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, at[good], 1)
    np.add.at(mark, at[good] + n[good] + window - 1, -1)
    return np.cumsum(mark[:-1]) > 0


def _found(column: pa.Array) -> Iterator[tuple[np.ndarray, ...] | None]:
    """Each row's spans (at, n, sum)."""
    values, ends = column.flatten(), column.offsets.to_numpy()
    at, n, sums = (values.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("at", "n", "sum"))
    ends = ends - ends[0]
    for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield (at[a:z], n[a:z], sums[a:z].view(np.uint64)) if z > a else None


def _marked(docs: DataFrame, key: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """docs in two parts, both with _FOUND: those of a text that others have too (all of it repeats), and the others with their spans of repeated windows."""
    spark = docs.sparkSession
    count = partitions(spark)
    hashed = docs.withColumns({_KEY: F.xxhash64(text), "_dedup_key2": F.xxhash64(F.lit(1), text)})
    two = [_KEY, "_dedup_key2"]
    copies = saved(hashed.groupBy(*two).agg(F.count("*").alias("_dedup_n"), F.min(key).alias("_dedup_rep")).where("_dedup_n > 1"))
    small = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    flagged = hashed.join(F.broadcast(copies) if small else copies, two, "left")
    if not small:
        flagged = saved(flagged)
    same, single = flagged.where("_dedup_n is not null"), flagged.where("_dedup_n is null")
    reps = same.where(F.col(key).eqNullSafe(F.col("_dedup_rep"))).groupBy(*two).agg(F.first(text).alias(_TEXT))
    reps = saved(reps.select(_KEY, _TEXT, F.lit(True).alias("many")))
    points = single.select(_KEY, F.col(text).alias(_TEXT), F.lit(False).alias("many")).union(reps)
    anchors = _repeated_anchors(points, window, 2 * count)
    dealt = single.select(*docs.columns, _KEY).repartition(count, _KEY)
    candidates = dealt.join(anchors, dealt[_KEY] == anchors["key"]).select(_KEY, F.col(text).alias(_TEXT), F.lit(False).alias("many"), _FOUND)
    heavy = reps.join(anchors, reps[_KEY] == anchors["key"]).select(_KEY, _TEXT, "many", _FOUND)
    graph = saved(_graph(candidates.union(heavy), window, 2 * count))
    occurs = graph.where("key is not null").join(_passages(graph), "path", "left").withColumn("passage", F.coalesce("passage", "path"))
    paths = occurs.groupBy("key").agg(F.collect_list(F.struct("at", "n", "sum", "passage")).alias(_FOUND))
    kept = dealt.join(paths, dealt[_KEY] == paths["key"], "left").drop(paths["key"])
    return same.select(*docs.columns), kept.select(*docs.columns, _FOUND)


def _cut(docs: DataFrame, key: str, text: str, window: int, made, schema: T.StructType) -> DataFrame:
    """made(row's batch, number, words as bytes, mark of removed words or None) for each row, as batches of columns."""
    same, other = _marked(docs, key, text, window)

    def run_same(batches):
        for b in batches:
            data, at = flat(b.column(text))
            parts = [data[a:z].tobytes().split() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield made(b, parts, [np.ones(len(p), bool) if len(p) >= window else None for p in parts])

    def run_other(batches):
        for b in batches:
            data, at = flat(b.column(text))
            parts, marks = [], []
            for k, spans in enumerate(_found(b.column(_FOUND))):
                parts.append(data[at[k] : at[k + 1]].tobytes().split())
                marks.append(covered(PLAIN.hashes(data, at[k : k + 2])[0], spans, window) if spans else None)
            yield made(b, parts, marks)

    return other.mapInArrow(tidy(run_other), schema).unionByName(same.mapInArrow(tidy(run_same), schema))


def digests(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_removed and kept_sha256 (of the kept words, joined by one space)."""
    docs = docs.select(key, text)
    schema = T.StructType([docs.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def made(b, parts, marks):
        kept = [p if m is None else list(compress(p, (~m).tolist())) for p, m in zip(parts, marks, strict=True)]
        removed = [len(p) - len(k) for p, k in zip(parts, kept, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(key), pa.array([len(p) for p in parts], pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept], pa.string())], names=schema.names)

    return _cut(docs, key, text, window, made, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their repeated passages cut out of `text`; all rows and columns stay.

    Texts without a repeated passage stay as they are; in others the kept words are joined by one space.
    """
    names = docs.columns

    def made(b, parts, marks):
        out = b.column(text).to_pylist()
        for k, (p, m) in enumerate(zip(parts, marks, strict=True)):
            if m is not None and m.any():
                out[k] = b" ".join(compress(p, (~m).tolist())).decode("utf-8")
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else b.column(n) for n in names], names=names)

    return _cut(docs, key, text, window, made, docs.schema)


def spans(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, passage, at, n_words): the verified repeated spans of the documents whose text no other has.

    Documents with spans of one passage share it; a span that other documents
    of its task have settled has no passage.
    """
    _, other = _marked(docs.select(key, text), key, text, window)
    schema = T.StructType([docs.schema[key], T.StructField("passage", T.LongType()), T.StructField("at", T.LongType()), T.StructField("n_words", T.LongType())])

    def run(batches):
        for b in batches:
            data, at = flat(b.column(text))
            rows = []
            for k, (found, raw) in enumerate(zip(_found(b.column(_FOUND)), b.column(_FOUND).to_pylist(), strict=True)):
                if found:
                    good = verified(PLAIN.hashes(data, at[k : k + 2])[0], found, window)
                    last = None
                    for x in sorted((r for r, g in zip(raw, good, strict=True) if g), key=lambda r: (r["passage"] is None, r["passage"] or 0, r["at"])):
                        if last and last[1] == x["passage"] and x["at"] <= last[2] + last[3]:
                            last[3] = max(last[3], x["at"] + x["n"] - last[2])
                        else:
                            rows.append(last := [b.column(key)[k].as_py(), x["passage"], x["at"], x["n"]])
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.column(key).type), *(pa.array(c, pa.int64()) for c in columns[1:3]), pa.array([n + window - 1 for n in columns[3]], pa.int64())], names=schema.names)

    return other.mapInArrow(tidy(run), schema)
