"""Identities: a game's tracklets contracted into players, cheapest merge first, and the roster cap with its relaxed re-merge.

The order of merges matters: a merged cluster has another gallery, other zones
and other spans, so costs are computed anew after every merge.  What can be
told before any merge is which tracklets can never meet in one cluster, however
their clusters grow: a merge needs either two tracklets that come as close as
one body (in a second or a shared frame, within a metre), or two vectors that
are alike at least as much as the mean of two galleries has to be.  Tracklets
linked by such pairs, at most GAP frames apart, form components.  Components are
found by joins and contracted each for itself, so merges in one never wait
for another; a task holds the tracklets of one component, with costs of
linked pairs only.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions import scalars
from matchlake.operators import intervals
from matchlake.operators.components import components
from matchlake.operators.tables import saved
from matchlake.operators.vectors import _matrix
from matchlake.params import Params

# Frames between parts of one player, most distant zones, cost of a relaxed merge.
GAP, ZONE_MOST, RELAXED_COST = 1800, 0.85, 0.65
# Frames and metres in which nobody else can step in, and what a whole metre costs.
SOON, METRE, METRE_COST = 15, 1.0, 0.05
# Frames, share and mean overlap of two boxes that are one body seen twice.
TWICE_FRAMES, TWICE_SHARE, TWICE_IOU = 30, 0.02, 0.40
# Frames after which a move counts half, vectors of a shape that a cluster keeps, cost of one shape step, share of a life beyond a side's players.
RELAX, GALLERY, SHAPE_STEP, EXCESS = 25.0, 10, 0.2 / 3, 0.25


class Rules(NamedTuple):
    """The parameters of the stage player_tracking that decide on identities."""

    look: float
    look_alone: float
    zone: float
    look_most: float
    opposite: float
    sure: float
    cost: float
    players: int
    frames: int
    in_play: float

    @classmethod
    def of(cls, params: Params | None = None) -> Rules:
        names = ("APPEARANCE_WEIGHT", "APPEARANCE_WEIGHT_WITHOUT_ZONES", "ZONE_WEIGHT", "APPEARANCE_MAX_DISTANCE", "SIDE_MISMATCH_PENALTY", "SIDE_MIN_CONFIDENCE", "MERGE_MAX_COST", "MAX_PLAYERS_PER_SIDE", "MIN_TRACKLET_FRAMES", "MIN_IN_PLAY_FRACTION")
        return cls(*((params or Params()).get("player_tracking", n) for n in names))


#: Frames of a slice in which presence is counted at once.
SLICE = 1 << 16

CORNERS = ("x1", "y1", "x2", "y2")


class Cluster:
    """Tracklets taken for one player: boxes by frame with their places on the court, spans, counts of sides and zones, and a gallery by shape."""

    __slots__ = ("name", "tracks", "at", "spans", "sides", "zones", "looks")

    def __init__(self, name, frames, boxes, courts, zones, looks):
        self.name, self.tracks = name, {name}
        self.at = {f: (b, c) for f, b, c in zip(frames, boxes, courts, strict=True)}
        self.spans = [(min(self.at), max(self.at))]
        self.sides = [sum(c is not None and c[0] < 9.0 for c in courts), sum(c is not None and not c[0] < 9.0 for c in courts)]
        self.zones = np.bincount([z for z in zones if z is not None], minlength=12)
        self.looks: dict[int, list[tuple[float, np.ndarray]]] = {}
        for shape, isolation, vector in looks:
            self.looks.setdefault(shape, []).append((isolation, vector))

    def side(self) -> tuple[str | None, float]:
        a, b = self.sides
        return ("A" if a >= b else "B", max(a, b) / (a + b)) if a + b else (None, 0.0)

    def frames(self) -> int:
        return sum(e - s + 1 for s, e in self.spans)

    def absorb(self, other: Cluster) -> None:
        """One box per frame, the larger one; galleries keep the most isolated vectors, or evenly spaced ones where all are equally so."""
        for f, seen in other.at.items():
            mine = self.at.get(f)
            if mine is None or _area(seen[0]) > _area(mine[0]):
                self.at[f] = seen
        self.spans = sorted(self.spans + other.spans)
        self.tracks |= other.tracks
        self.sides = [p + q for p, q in zip(self.sides, other.sides, strict=True)]
        self.zones = self.zones + other.zones
        for shape, more in other.looks.items():
            held = self.looks.setdefault(shape, [])
            held.extend(more)
            if len(held) > GALLERY:
                if len({i for i, _ in held}) > 1:
                    held.sort(key=lambda v: -v[0])
                    del held[GALLERY:]
                else:
                    held[:] = [held[k] for k in sorted({int(k) for k in np.linspace(0, len(held) - 1, GALLERY).round()})]


def _area(b) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = w * h if w > 0 and h > 0 else 0.0
    return both / (_area(a) + _area(b) - both) if both else 0.0


def bridge(a: Cluster, b: Cluster):
    """(gap, a's box and place, b's box and place) where the clusters come closest in time; None if they are seen apart at one time."""
    if a.spans[0][0] > b.spans[0][0]:
        found = bridge(b, a) if b.spans[0][0] < a.spans[0][0] else None
        return found and (found[0], found[2], found[1])
    a_end = max(e for _, e in a.spans)
    if a_end < b.spans[0][0]:
        return b.spans[0][0] - a_end, a.at[a_end], b.at[b.spans[0][0]]
    shared = a.at.keys() & b.at.keys()
    if shared:
        few = len(shared) <= TWICE_FRAMES and len(shared) <= TWICE_SHARE * min(len(a.at), len(b.at))
        if not few or sum(_iou(a.at[f][0], b.at[f][0]) for f in shared) / len(shared) < TWICE_IOU:
            return None
        return 0, a.at[min(shared)], b.at[min(shared)]
    best, i, j = None, 0, 0
    while i < len(a.spans) and j < len(b.spans):
        (s, e), (t, u) = a.spans[i], b.spans[j]
        if s <= u and t <= e:
            return None
        gap, pair = (t - e, (a.at[e], b.at[t])) if e < t else (s - u, (a.at[s], b.at[u]))
        if best is None or gap < best[0]:
            best = (gap, *pair)
        i, j = (i + 1, j) if e < t else (i, j + 1)
    return best


def look_distance(a: Cluster, b: Cluster) -> float | None:
    """Mean half cosine distance of all pairs of vectors, with the cost of differing shapes; no pair counts more than 1."""
    total, count = 0.0, 0
    for p, left in a.looks.items():
        x = np.array([v for _, v in left])
        for q, right in b.looks.items():
            d = (1 - np.clip(x @ np.array([v for _, v in right]).T, -1, 1)) / 2
            total += np.minimum(1.0, d + SHAPE_STEP * abs(p - q)).sum()
            count += d.size
    return total / count if count else None


def zone_distance(a: Cluster, b: Cluster) -> float | None:
    p, q = a.zones.sum(), b.zones.sum()
    return 1.0 - float(np.minimum(a.zones / p, b.zones / q).sum()) if p and q else None


def cost(a: Cluster, b: Cluster, diagonal: float, rules: Rules, most: float) -> float | None:
    """What taking two clusters for one player costs; None if they can't be or it is above `most`."""
    (side_a, sure_a), (side_b, sure_b) = a.side(), b.side()
    differ = side_a and side_b and side_a != side_b
    if differ and min(sure_a, sure_b) >= rules.sure:
        return None
    near = bridge(a, b)
    if near is None or near[0] > GAP:
        return None
    gap, (box_a, court_a), (box_b, court_b) = near
    if gap <= SOON and court_a is not None and court_b is not None:
        moved = float(np.hypot(court_a[0] - court_b[0], court_a[1] - court_b[1]))
        if moved <= METRE:
            return METRE_COST * moved / METRE
    zone = zone_distance(a, b)
    if zone is not None and zone > ZONE_MOST:
        return None
    look = look_distance(a, b)
    if look is None or look > rules.look_most:
        return None
    centre = [((p[0] + p[2]) / 2, (p[1] + p[3]) / 2) for p in (box_a, box_b)]
    spatial = min(1.0, float(np.hypot(centre[0][0] - centre[1][0], centre[0][1] - centre[1][1])) / diagonal / (1.0 + gap / RELAX))
    whole = rules.look_alone * look + (1 - rules.look_alone) * spatial if zone is None else rules.look * look + rules.zone * zone + max(0.0, 1 - rules.look - rules.zone) * spatial
    whole += rules.opposite * min(sure_a, sure_b) if differ else 0.0
    return whole if whole <= most else None


def contracted(clusters: list[Cluster], linked: dict, diagonal: float, rules: Rules) -> tuple[list[Cluster], list[tuple]]:
    """The clusters after all merges, always the cheapest pair first (of equals the smaller pair), and the merges (into, merged, cost).

    linked: for each cluster's name the names that it may ever share a cluster with directly.
    A heap holds the costs of linked pairs; those of merged clusters are out of date and skipped.
    """
    alive = {c.name: c for c in clusters}
    linked = {n: set(linked.get(n, ())) for n in alive}
    age = dict.fromkeys(alive, 0)
    heap, log = [], []

    def weigh(a, b) -> None:
        a, b = min(a, b), max(a, b)
        c = cost(alive[a], alive[b], diagonal, rules, rules.cost)
        if c is not None:
            heapq.heappush(heap, (c, a, b, age[a], age[b]))

    for a in alive:
        for b in linked[a]:
            if a < b:
                weigh(a, b)
    while heap:
        c, a, b, i, j = heapq.heappop(heap)
        if a not in alive or b not in alive or age[a] != i or age[b] != j:
            continue
        log.append((a, b, c))
        alive[a].absorb(alive.pop(b))
        age[a] += 1
        for n in linked.pop(b):
            linked[n].discard(b)
            if n != a:
                linked[n].add(a)
                linked[a].add(n)
        for n in linked[a]:
            weigh(a, n)
    return [alive[n] for n in sorted(alive)], log


def capped(clusters: list[Cluster], extra: list, diagonal: float, rules: Rules) -> dict:
    """The clusters beyond a side's players, `extra` in turn, merged into the cheapest of the others under the relaxed bar: {name: into}."""
    primary, moved = [c for c in clusters if c.name not in set(extra)], {}
    named = {c.name: c for c in clusters}
    for n in extra:
        best = None
        for p in primary:
            c = cost(p, named[n], diagonal, rules, RELAXED_COST)
            if c is not None and c < (best[0] if best else RELAXED_COST):
                best = (c, p)
        if best:
            best[1].absorb(named[n])
            moved[n] = best[1].name
    return moved


def tracks_of(boxes: DataFrame, vectors: DataFrame, game: str, track: str, frame: str, rules: Rules) -> DataFrame:
    """One row per tracklet that is long enough and enough in play: (game, track, seen, looks, start, end, placed).

    boxes: (game, track, frame, x1, y1, x2, y2, u, v), u and v the foot point on
    the court, null without calibration.  vectors: (game, track, shape,
    isolation, vector); missing vectors don't count.
    """
    inside = scalars.in_play_area(F.col("u"), F.col("v"), F.col("u").isNotNull())
    court = F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), F.array("u", "v"))
    zone = scalars.zone_cell(F.col("u"), F.col("v"))
    box = F.array(*[F.col(c).cast("double") for c in CORNERS])
    seen = F.sort_array(F.collect_list(F.struct(F.col(frame).alias("f"), box.alias("b"), court.alias("c"), zone.cast("int").alias("z"))))
    rows = boxes.groupBy(game, track).agg(seen.alias("seen"), F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("_in"), F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("u").alias("placed"))
    rows = rows.where((F.size("seen") >= rules.frames) & (F.col("_in") >= rules.in_play)).drop("_in")
    look = F.struct(F.col("shape").cast("int").alias("shape"), F.col("isolation").cast("double").alias("isolation"), F.col("vector").cast("array<double>").alias("vector"))
    looks = vectors.where("vector is not null").groupBy(game, track).agg(F.sort_array(F.collect_list(look)).alias("looks"))
    return rows.join(looks, [game, track], "left")


#: Tracklets of a part of a time slice; two parts meet in a task.
SQUARE = 256


def _closest(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Per pair of galleries the least distance of two vectors."""
    out = np.full((len(left), len(right)), np.inf)
    (p, x, k), (q, y, m) = (_flat(t.column("looks")) for t in (left, right))
    if not len(p) or not len(q):
        return out
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    bounds = np.searchsorted(p, np.arange(len(left) + 1))
    for n in np.unique(p):
        own = slice(bounds[n], bounds[n + 1])
        d = (1 - np.clip(x[own] @ y.T, -1, 1)) / 2 + SHAPE_STEP * np.abs(k[own][:, None] - m)
        out[n, q[first]] = np.minimum(1.0, np.minimum.reduceat(d.min(0), first))
    return out


def _flat(looks: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of galleries one below the other: whose, the vectors, their shapes."""
    looks = looks.combine_chunks()
    of, each = pc.list_parent_indices(looks).to_numpy().astype(int), pc.list_flatten(looks)
    return of, _matrix(pa.chunked_array([each.field("vector")])) if len(of) else np.zeros((0, 1)), each.field("shape").to_numpy(zero_copy_only=False)


def possible_links(tracks: DataFrame, game: str, track: str, rules: Rules) -> DataFrame:
    """(game, a, b): pairs of tracklets of calibrated games that could bring their clusters together.

    Games are cut into slices of GAP frames, in each of which the tracklets that
    begin there meet those that ended less than GAP frames before or still run;
    slices with many are dealt to squares.  Boxes and vectors go to a slice once,
    not once for each pair.
    """
    given = tracks.where("placed > 0").dropna(subset=[game, track, "start", "end"]).select(game, track, "seen", "looks", "start", "end")
    at = lambda c: F.floor(c / GAP)
    earlier = given.withColumn("_k", F.explode(F.sequence(at(F.col("start")), at(F.col("end") + GAP))))
    later = given.select(*[F.col(c).alias(c) for c in given.columns]).withColumn("_k", at(F.col("start")))
    count = lambda df, n: df.groupBy(game, "_k").agg(F.count("*").alias(n))
    sizes = count(earlier, "_x").join(count(later, "_y"), [game, "_k"])
    many = F.broadcast(sizes.select(game, "_k", F.ceil(F.greatest("_x", "_y") / SQUARE).alias("_n")).where("_n > 1"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        part = df.join(many, [game, "_k"], "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
        return part.withColumns({own: F.pmod(F.xxhash64(track), F.col("_n")), other: F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))}).drop("_n")

    keys, most = [game, "_k", "_i", "_j"], rules.look_most
    kinds = given.schema

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (t.column(track).combine_chunks() for t in (left, right))
        names = pa.chunked_array([a, b]).unique().sort()
        i, j = np.zeros(0, int), np.zeros(0, int)
        if len(a) and len(b):
            (s, e, n), (t, _, m) = ((*(x.column(c).to_numpy() for c in ("start", "end")), pc.index_in(x.column(track), value_set=names).to_numpy()) for x in (left, right))
            follows = (t > s[:, None]) | ((t == s[:, None]) & (m > n[:, None]))
            follows &= t <= e[:, None] + GAP
            keep = follows & (_closest(left, right) <= most + 1e-9)
            open_ = np.argwhere(follows & ~keep & (t <= e[:, None] + SOON))
            if len(open_):
                seen_a, seen_b = (dict(zip(u.tolist(), x.column("seen").take(pa.array(u)).to_pylist(), strict=True)) for x, u in ((left, np.unique(open_[:, 0])), (right, np.unique(open_[:, 1]))))
                for p, q in open_.tolist():
                    keep[p, q] = _touch(seen_a[p], seen_b[q])
            i, j = np.nonzero(keep)
        games = (left if len(left) else right).column(game).take(pa.array(np.zeros(len(i), int)))
        return pa.table({game: games, "a": a.take(pa.array(i)), "b": b.take(pa.array(j))})

    schema = f"{game} {kinds[game].dataType.simpleString()}, a {kinds[track].dataType.simpleString()}, b {kinds[track].dataType.simpleString()}"
    return _in_groups(dealt(earlier, "_i", "_j"), dealt(later, "_j", "_i"), keys, run, schema)


def _touch(a: list[dict], b: list[dict]) -> bool:
    """Whether one body may have gone from one tracklet to the other, or been boxed by both."""
    close = lambda p, q: p["c"] is not None and q["c"] is not None and np.hypot(p["c"][0] - q["c"][0], p["c"][1] - q["c"][1]) <= METRE + 1e-9
    ends = [(a[-1], b[0]), (b[-1], a[0])]
    if any(0 < q["f"] - p["f"] <= SOON and close(p, q) for p, q in ends):
        return True
    at = {p["f"]: p for p in a}
    return any(close(at[q["f"]], q) for q in b if q["f"] in at)


def _clusters(table: pa.Table, track: str) -> list[Cluster]:
    made = []
    for r in table.select([track, "seen", "looks"]).to_pylist():
        seen = r["seen"]
        looks = [(v["shape"], v["isolation"], np.array(v["vector"])) for v in r["looks"] or ()]
        made.append(Cluster(r[track], [s["f"] for s in seen], [s["b"] for s in seen], [s["c"] for s in seen], [s["z"] for s in seen], looks))
    return made


def _in_groups(left: DataFrame, right: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def consolidated(boxes: DataFrame, vectors: DataFrame, game: str, track: str, frame: str, diagonal: float, params: Params | None = None) -> DataFrame:
    """(game, track, cluster, into, step, cost): tracklets with their identity, named by its smallest tracklet; for merged ones also the cluster they were merged into, as which merge of theirs, and at what cost.

    Tracklets that are too short or out of play are left out.  In games without
    calibration nothing is merged: each tracklet is a provisional identity.
    Every game's result is that of merging its cheapest pair first, until none is left.
    """
    kind, ident = boxes.schema[game].dataType.simpleString(), boxes.schema[track].dataType.simpleString()
    rules = Rules.of(params)
    tracks = saved(tracks_of(boxes, vectors, game, track, frame, rules))
    links = saved(possible_links(tracks, game, track, rules))
    node = lambda c: F.xxhash64(game, c)
    roots = components(links.select(node("a").alias("a"), node("b").alias("b")))
    named = tracks.join(roots, node(track) == F.col("node"), "left")
    schema = f"{game} {kind}, {track} {ident}, cluster {ident}, into {ident}, step int, cost double"
    alone = named.where("root is null").select(game, track, F.col(track).alias("cluster"), F.lit(None).cast(ident).alias("into"), F.lit(None).cast("int").alias("step"), F.lit(None).cast("double").alias("cost"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        games: dict = {}
        for g, n in zip(left.column(game).to_pylist(), _clusters(left, track), strict=True):
            games.setdefault(g, []).append(n)
        linked: dict = {g: {} for g in games}
        for g, a, b in zip(*(right.column(c).to_pylist() for c in (game, "a", "b")), strict=True):
            linked[g].setdefault(a, []).append(b)
            linked[g].setdefault(b, []).append(a)
        rows = []
        for g, members in games.items():
            found, log = contracted(members, linked[g], diagonal, rules)
            merged = {b: (a, k, c) for k, (a, b, c) in enumerate(log)}
            rows += [(g, t, c.name, *merged.get(t, (None,) * 3)) for c in found for t in sorted(c.tracks)]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = (left.schema.field(game).type, *[left.schema.field(track).type] * 3, pa.int32(), pa.float64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip((game, track, "cluster", "into", "step", "cost"), columns, types, strict=True)})

    groups = named.where("root is not null").select(F.col("root").alias("part"), game, track, "seen", "looks")
    inner = links.join(roots, node("a") == F.col("node")).select(F.col("root").alias("part"), F.col(game).alias(game), "a", "b")
    return _in_groups(groups, inner, ["part"], run, schema).unionByName(alone)


def rostered(boxes: DataFrame, vectors: DataFrame, found: DataFrame, game: str, track: str, frame: str, diagonal: float, players: int | None = None, params: Params | None = None) -> DataFrame:
    """(game, cluster, side, final, likely_non_player): what the roster cap makes of consolidated identities; players: of a side, else the parameter.

    Where more than `players` surely placed identities of a side are seen at
    once, those with the shortest lives are extra.  Each of them, in the order in
    which they first are, is merged into the cheapest of the others under the
    relaxed bar, if one is; else it is likely no player if it was extra for a
    quarter of its life.  Sides that are never too many go to no task.
    """
    kind, ident = boxes.schema[game].dataType.simpleString(), boxes.schema[track].dataType.simpleString()
    rules = Rules.of(params)
    players = rules.players if players is None else players
    tracks = saved(tracks_of(boxes, vectors, game, track, frame, rules).join(found.select(game, track, "cluster", "into", "step"), [game, track]))
    sides = tracks.select(game, "cluster", "start", "end", F.aggregate("seen", F.lit(0), lambda s, x: s + (x["c"].isNotNull() & (x["c"][0] < 9.0)).cast("int")).alias("_a"), F.size(F.filter("seen", lambda x: x["c"].isNotNull())).alias("_n"))
    lives = sides.groupBy(game, "cluster").agg(F.sum("_a").alias("_a"), F.sum("_n").alias("_n"), F.sum(F.col("end") - F.col("start") + 1).alias("life"))
    side, sure = scalars.side_of(F.col("_a"), F.col("_n") - F.col("_a"))
    lives = saved(lives.withColumn("side", F.when(sure >= rules.sure, side)).select(game, "cluster", "side", "life"))
    spans = sides.join(lives.where("side is not null"), [game, "cluster"]).select(game, "side", "cluster", F.col("start").alias("s"), (F.col("end") + 1).alias("e"), "life")
    extra = saved(intervals.excess(spans, [game, "side"], "cluster", "s", "e", "life", players, slice_=SLICE, first="since"))
    mine = tracks.join(lives.drop("life"), [game, "cluster"]).join(extra.select(game, "side").distinct(), [game, "side"], "left_semi")
    schema = f"{game} {kind}, side string, cluster {ident}, final {ident}"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = {c.name: c for c in _clusters(left, track)}
        merges = zip(*(left.column(c).to_pylist() for c in ("cluster", "step", "into", track)), strict=True)
        for _, _, into, name in sorted(m for m in merges if m[1] is not None):
            parts[into].absorb(parts.pop(name))
        order = [c for *_, c in sorted(zip(*(right.column(c).to_pylist() for c in ("since", "life", "cluster")), strict=True))]
        moved = capped([parts[n] for n in sorted(parts)], order, diagonal, rules)
        names = right.column("cluster").to_pylist()
        return right.select([game, "side", "cluster"]).append_column("final", pa.array([moved.get(n) for n in names], right.schema.field("cluster").type))

    last = extra.join(lives.select(game, "cluster", "life"), [game, "cluster"]).select(game, "side", "cluster", "since", "life")
    final = _in_groups(mine.select(game, "side", "cluster", track, "seen", "looks", "into", "step"), last, [game, "side"], run, schema)
    out = lives.join(extra.select(game, "cluster", "excess"), [game, "cluster"], "left").join(final.select(game, "cluster", "final"), [game, "cluster"], "left")
    beyond: Column = F.col("excess").isNotNull() & F.col("final").isNull() & (F.col("excess") >= EXCESS * F.col("life"))
    return out.select(game, "cluster", "side", F.coalesce("final", "cluster").alias("final"), F.coalesce(beyond, F.lit(False)).alias("likely_non_player"))
