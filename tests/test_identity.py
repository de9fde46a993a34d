"""Identities against a plain loop that always merges the cheapest pair of all."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from matchlake import catalog
from matchlake.operators import identity, intervals
from matchlake.plans import identities

DIAGONAL = 2000.0


def dist(u, v, p, q):
    return min(1.0, min(1.0, max(0.0, (1 - max(-1.0, min(1.0, sum(a * b for a, b in zip(u, v, strict=True))))) / 2)) + 0.2 * abs(p - q) / 3)


def pair_cost(a, b, most):
    """Clusters are dicts: seen {frame: (box, court)}, spans, sides, zones, looks {shape: [(isolation, vector)]}."""

    def side(c):
        n = sum(c["sides"])
        return ("A" if c["sides"][0] >= c["sides"][1] else "B", max(c["sides"]) / n) if n else (None, 0.0)

    (s, p), (t, q) = side(a), side(b)
    differ = s is not None and t is not None and s != t
    if differ and p >= 0.7 and q >= 0.7:
        return None
    shared = sorted(set(a["seen"]) & set(b["seen"]))
    if shared:
        boxes = [(a["seen"][f][0], b["seen"][f][0]) for f in shared]
        over = []
        for x, y in boxes:
            w, h = min(x[2], y[2]) - max(x[0], y[0]), min(x[3], y[3]) - max(x[1], y[1])
            i = max(0, w) * max(0, h)
            over.append(i / ((x[2] - x[0]) * (x[3] - x[1]) + (y[2] - y[0]) * (y[3] - y[1]) - i))
        if len(shared) > 30 or len(shared) / min(len(a["seen"]), len(b["seen"])) > 0.02 or sum(over) / len(over) < 0.4:
            return None
        gap, one, two = 0, a["seen"][shared[0]], b["seen"][shared[0]]
    else:
        options = []
        for i, j in a["spans"]:
            for k, m in b["spans"]:
                if i <= m and k <= j:
                    return None
                options.append((k - j, a["seen"][j], b["seen"][k]) if j < k else (i - m, a["seen"][i], b["seen"][m]))
        gap, one, two = min(options, key=lambda o: o[0])
    if gap > 1800:
        return None
    if gap <= 15 and one[1] and two[1] and math.dist(one[1], two[1]) <= 1.0:
        return 0.05 * math.dist(one[1], two[1])
    m, n = sum(a["zones"]), sum(b["zones"])
    zone = 1 - sum(min(x / m, y / n) for x, y in zip(a["zones"], b["zones"], strict=True)) if m and n else None
    if zone is not None and zone > 0.85:
        return None
    every = [dist(u, v, g, h) for g, x in a["looks"].items() for _, u in x for h, y in b["looks"].items() for _, v in y]
    if not every or sum(every) / len(every) > 0.22:
        return None
    look = sum(every) / len(every)
    mid = lambda z: ((z[0] + z[2]) / 2, (z[1] + z[3]) / 2)
    far = min(1.0, math.dist(mid(one[0]), mid(two[0])) / DIAGONAL / (1 + gap / 25))
    total = (0.85 * look + 0.15 * far if zone is None else 0.45 * look + 0.4 * zone + 0.15 * far) + (0.35 * min(p, q) if differ else 0)
    return total if total <= most else None


def absorb(a, b):
    area = lambda z: (z[2] - z[0]) * (z[3] - z[1])
    for f, s in b["seen"].items():
        if f not in a["seen"] or area(s[0]) > area(a["seen"][f][0]):
            a["seen"][f] = s
    a["spans"] = a["spans"] + b["spans"]
    a["sides"] = [x + y for x, y in zip(a["sides"], b["sides"], strict=True)]
    a["zones"] = [x + y for x, y in zip(a["zones"], b["zones"], strict=True)]
    for g, x in b["looks"].items():
        mine = a["looks"].setdefault(g, [])
        mine += x
        if len(mine) > 10:
            if len({i for i, _ in mine}) > 1:
                mine.sort(key=lambda v: -v[0])
                del mine[10:]
            else:
                a["looks"][g] = [mine[k] for k in sorted({round(j * (len(mine) - 1) / 9) for j in range(10)})]


def loop(tracks):
    found = {n: c for n, c in sorted(tracks.items())}
    of = {n: n for n in found}
    while True:
        best = min(((c, a, b) for a in found for b in found if a < b and (c := pair_cost(found[a], found[b], 0.45)) is not None), default=None)
        if best is None:
            return found, of
        _, a, b = best
        absorb(found[a], found.pop(b))
        of = {n: a if m == b else m for n, m in of.items()}


def cap(found, players):
    moved, beyond = {}, set()
    for s in "AB":
        mine = [n for n, c in sorted(found.items()) if sum(c["sides"]) and ("A" if c["sides"][0] >= c["sides"][1] else "B") == s and max(c["sides"]) / sum(c["sides"]) >= 0.7]
        life = {n: sum(e - b + 1 for b, e in found[n]["spans"]) for n in mine}
        extra = {}
        for t in range(min((b for n in mine for b, _ in found[n]["spans"]), default=0), max((e for n in mine for _, e in found[n]["spans"]), default=-1) + 1):
            here = sorted((n for n in mine if any(b <= t <= e for b, e in found[n]["spans"])), key=lambda n: (life[n], n))
            for n in here[: max(0, len(here) - players)]:
                extra[n] = extra.get(n, 0) + 1
        rest = [n for n in mine if n not in extra]
        for n in extra:
            best = min(((c, p) for p in rest if (c := pair_cost(found[p], found[n], 0.65)) is not None and c < 0.65), default=None)
            if best:
                absorb(found[best[1]], found[n])
                moved[n] = best[1]
            elif extra[n] >= 0.25 * life[n]:
                beyond.add(n)
    return moved, beyond


def game(rng, calibrated=True, tracks=26, people=5):
    """Random tracklets of a few people, with boxes, places and vectors; some are one body seen twice."""
    boxes, vectors = [], []
    looks = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(people)]
    for t in range(tracks):
        who = rng.randrange(people)
        start, n = rng.randrange(2500), rng.choice([1, 2, 5, 30, 120])
        u, v = rng.uniform(0, 18) if rng.random() < 0.3 else 2.0 + 3 * who, rng.uniform(-1, 10)
        if boxes and rng.random() < 0.35:
            last = max(b for b in boxes if b[0] == boxes[-1][0])
            start, u, v = last[1] + rng.choice([1, 4, 12, 0]), (last[6] if last[6] is not None else 1.0) + rng.uniform(-0.6, 0.6), last[7] if last[7] is not None else 1.0
        for f in range(start, start + n):
            x, y = 60 * u + rng.uniform(-3, 3), 40 * v
            boxes.append((t, f, x, y, x + 40 + rng.random(), y + 90, u if calibrated else None, v if calibrated else None))
            u, v = u + rng.uniform(-0.05, 0.05), v + rng.uniform(-0.05, 0.05)
        for _ in range(rng.choice([0, 1, 4, 12])):
            z = [a + rng.gauss(0, 0.35) for a in looks[who]]
            k = math.hypot(*z)
            vectors.append((t, rng.randrange(3), float(rng.choice([1, 1, 2, 5])) if t % 3 else 7.0, [a / k for a in z]))
    return boxes, vectors


def plain(boxes, vectors):
    out = {}
    for t in {b[0] for b in boxes}:
        mine = sorted(b[1:] for b in boxes if b[0] == t)
        inside = [b for b in mine if b[5] is None or (b[5] is not None and 0 <= b[6] <= 9 and -6 <= b[5] <= 24)]
        if len(mine) < 2 or len(inside) / len(mine) < 0.5:
            continue
        courts = [(b[5], b[6]) for b in mine if b[5] is not None]
        zones = [0] * 12
        for u, v in courts:
            zones[(0 if u < 9 else 6) + (0 if abs(u - 9) < 4.5 else 3) + min(2, max(0, math.floor(v / 3)))] += 1
        looks = {}
        for _, g, i, z in sorted(v for v in vectors if v[0] == t):
            looks.setdefault(g, []).append((i, z))
        looks = {g: sorted(x) for g, x in looks.items()}
        out[t] = {"seen": {b[0]: (b[1:5], (b[5], b[6]) if b[5] is not None else None) for b in mine}, "spans": [(mine[0][0], mine[-1][0])], "sides": [sum(u < 9 for u, _ in courts), sum(u >= 9 for u, _ in courts)], "zones": zones, "looks": looks}
    return out


BOXES, VECTORS = "game int, track int, frame int, x1 double, y1 double, x2 double, y2 double, u double, v double", "game int, track int, shape int, isolation double, vector array<double>"


def test_consolidation_and_cap_equal_the_loop(spark):
    games = {g: game(random.Random(g), calibrated=g != 3) for g in range(6)}
    boxes = spark.createDataFrame([(g, *b) for g, (x, _) in games.items() for b in x], BOXES).repartition(3)
    vectors = spark.createDataFrame([(g, *v) for g, (_, x) in games.items() for v in x] + [(0, 1, 0, 0.0, None)], VECTORS)
    got = identity.consolidated(boxes, vectors, "game", "track", "frame", DIAGONAL)
    rows = got.collect()
    want, capped = set(), set()
    for g, (x, y) in games.items():
        tracks = plain(x, y)
        if g == 3:
            want |= {(g, t, t) for t in tracks}
            capped |= {(g, t, t, False) for t in tracks}
            continue
        found, of = loop(tracks)
        want |= {(g, t, c) for t, c in of.items()}
        moved, beyond = cap(found, 1)
        capped |= {(g, c, moved.get(c, c), c in beyond) for c in found}
    assert {(r["game"], r["track"], r["cluster"]) for r in rows} == want
    assert sum(r["into"] is not None for r in rows) > 20
    out = identity.rostered(boxes, vectors, got, "game", "track", "frame", DIAGONAL, players=1)
    assert {(r["game"], r["cluster"], r["final"], r["likely_non_player"]) for r in out.collect()} == capped
    assert any(c[3] for c in capped)


def test_relaxed_merge(spark):
    """Track 1 is extra beside the longer 0 and joins 2, whose zones it shares only a little."""
    line = lambda t, start, n, zones, off=0.0: [(t, start + k, 50.0 * u + off, 40.0 * v, 50.0 * u + 40 + off, 40.0 * v + 90, u, v) for k in range(n) for u, v in [zones[k % len(zones)]]]
    boxes = line(0, 0, 200, [(1.0, 1.0)]) + line(1, 150, 40, [(1.0, 4.0)]) + line(2, 206, 300, [(6.0, 7.0)] * 3 + [(1.0, 4.0)], 4000.0)
    near = [0.8, 0.6]
    vectors = [(0, 0, 1.0, [-1.0, 0.0]), (1, 0, 1.0, [1.0, 0.0]), (2, 0, 1.0, near), (2, 0, 2.0, near)]
    found, of = loop(plain(boxes, vectors))
    assert of == {0: 0, 1: 1, 2: 2} and cap(found, 1) == ({1: 2}, set())
    b, v = spark.createDataFrame([(1, *x) for x in boxes], BOXES), spark.createDataFrame([(1, *x) for x in vectors], VECTORS)
    got = identity.consolidated(b, v, "game", "track", "frame", DIAGONAL)
    out = identity.rostered(b, v, got, "game", "track", "frame", DIAGONAL, players=1)
    assert sorted((r["cluster"], r["final"], r["likely_non_player"]) for r in out.collect()) == [(0, 0, False), (1, 2, False), (2, 2, False)]


def test_parameters_decide(spark):
    """A lower bar leaves more identities; longer tracklets asked for leave fewer."""
    from matchlake.params import Params

    x, y = game(random.Random(2))
    boxes, vectors = spark.createDataFrame([(1, *b) for b in x], BOXES), spark.createDataFrame([(1, *v) for v in y], VECTORS)
    count = lambda **v: identity.consolidated(boxes, vectors, "game", "track", "frame", DIAGONAL, Params().patched({"player_tracking": v})).select("cluster").distinct().count()
    usual = count()
    assert count(MERGE_MAX_COST=0.0) > usual > count(MIN_TRACKLET_FRAMES=30)


def test_empty(spark):
    boxes, vectors = spark.createDataFrame([], BOXES), spark.createDataFrame([], VECTORS)
    got = identity.consolidated(boxes, vectors, "game", "track", "frame", DIAGONAL)
    assert got.collect() == [] and identity.rostered(boxes, vectors, got, "game", "track", "frame", DIAGONAL).collect() == []


@pytest.mark.parametrize("slice_", [7, 1 << 20])
def test_excess_equals_counting(spark, slice_):
    rng = random.Random(slice_)
    rows = [(g, m, s, s + rng.randrange(0, 25), m % 3) for g in (1, None) for m in range(9) for s in (rng.randrange(60), rng.randrange(60))]
    df = spark.createDataFrame(rows, "game int, member int, s int, e int, strength int").repartition(3)
    got = intervals.excess(df, ["game"], "member", "s", "e", "strength", 2, slice_=slice_, first="since")
    want = {}
    for g in (1, None):
        for t in range(90):
            here = sorted({(w, m) for h, m, s, e, w in rows if h == g and s <= t < e})
            for _, m in here[: max(0, len(here) - 2)]:
                n, since = want.get((g, m), (0, t))
                want[g, m] = (n + 1, since)
    assert {(r["game"], r["member"]): (r["excess"], r["since"]) for r in got.collect()} == want


def test_queries_equal_the_loop(spark):
    d = "/root/testdata/sf0.001"
    boxes, vectors = (df.collect() for df in identities.tracklets(spark, d))
    want, capped = set(), set()
    for g in {b["game"] for b in boxes}:
        tracks = plain([(*b[1:],) for b in boxes if b["game"] == g], [(*v[1:],) for v in vectors if v["game"] == g])
        found, of = loop(tracks) if g % 7 != 6 else (dict(tracks), {t: t for t in tracks})
        want |= {(g, t, c) for t, c in of.items()}
        moved, beyond = cap(found, 2)
        capped |= {(g, c, moved.get(c, c), c in beyond) for c in found}
    got = catalog.queries()["player_identities"](spark, d).collect()
    assert {(r["game"], r["track"], r["cluster"]) for r in got} == want and len(got) > 100
    out = catalog.queries()["roster_identities"](spark, d).collect()
    assert {(r["game"], r["cluster"], r["final"], r["likely_non_player"]) for r in out} == capped


def test_possible_links_in_squares_against_all_pairs(spark, monkeypatch):
    rng, gen = random.Random(2), np.random.default_rng(2)
    boxes, looks = [], []
    for g in range(2):
        for t in range(30):
            start, kind = rng.randrange(6000), rng.randrange(6)
            boxes += [(g, t, f, 0.0, 0.0, 60.0, 150.0, rng.choice([4.0, 4.5, 12.0]), 4.0) for f in range(start, start + rng.choice([3, 9, 2500]), rng.choice([1, 7, 20]))]
            looks += [(g, t, rng.randrange(3), 1.0, v.tolist()) for v in gen.normal(size=(rng.choice([0, 2, 3]), 3)) + np.eye(6)[kind][:3] * 4]
    looks = [(*r[:4], (np.array(r[4]) / np.linalg.norm(r[4])).tolist()) for r in looks]
    b = spark.createDataFrame(boxes, "game int, track int, frame int, x1 double, y1 double, x2 double, y2 double, u double, v double")
    v = spark.createDataFrame(looks, "game int, track int, shape int, isolation double, vector array<double>")
    rules = identity.Rules.of(None)._replace(frames=1, in_play=0.0)
    tracks = identity.tracks_of(b, v, "game", "track", "frame", rules)
    held, want = tracks.collect(), set()
    for p in held:
        for q in held:
            if p.game == q.game and (p.start, p.track) < (q.start, q.track) and q.start <= p.end + identity.GAP:
                d = [min(1.0, (1 - np.dot(x.vector, y.vector)) / 2 + identity.SHAPE_STEP * abs(x.shape - y.shape)) for x in p.looks or () for y in q.looks or ()]
                if d and min(d) <= rules.look_most + 1e-9 or identity._touch([s.asDict() for s in p.seen], [s.asDict() for s in q.seen]):
                    want.add((p.game, p.track, q.track))
    assert len(want) > 20
    for size in (256, 4):
        monkeypatch.setattr(identity, "SQUARE", size)
        got = [tuple(r) for r in identity.possible_links(tracks, "game", "track", rules).collect()]
        assert len(got) == len(set(got)) and set(got) == want
