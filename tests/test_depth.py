"""Operators with machinery of their own against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.operators import contacts, detection, ordered, ranks, tables, vectors
from matchlake.params import Params


@pytest.mark.parametrize("seed", [1, 2])
def test_separated_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(g, float(rng.randrange(900)) / 3, rng.choice([None, 1.0, 2.0, 3.5])) for g in ("a", None) for _ in range(300)] + [("b", None, 1.0)]
    df = spark.createDataFrame(rows, "game string, t double, s double").repartition(3)
    got = sorted(ordered.separated(df, ["game"], "t", "s", 2.0).collect(), key=str)
    want = []
    for g in ("a", None):
        kept = []
        for t, s in sorted(((t, s) for h, t, s in rows if h == g and t is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
            if not kept or t - kept[-1][0] > 2.0:
                kept.append((t, s))
            elif (s or 0) > (kept[-1][1] or 0):
                kept[-1] = (t, s)
        want += [(g, *k) for k in kept]
    assert [tuple(r) for r in got] == sorted(want, key=str)


def test_separated_long_key(spark):
    """A key of 300,000 rows, without a gap and with one at every second row."""
    df = spark.range(300_000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), (F.col("id") % 7).cast("double").alias("s"))
    assert ordered.separated(df, ["k"], "t", "s", 0.5).count() == 300_000
    assert ordered.separated(df, ["k"], "t", "s", 1.0).count() < 300_000


def test_ranked_and_running(spark, monkeypatch):
    monkeypatch.setattr(ranks, "WIDTH", 5)
    rng = random.Random(3)
    rows = [(k, rng.choice(["b", "a", None, "é", "zz"]), rng.randrange(9)) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, s string, n int").repartition(4)
    placed = ranks.ranked(df, F.col("s").desc_nulls_last(), "id")
    order = sorted(rows, key=lambda r: r[0])
    order = [r for s in ("é", "zz", "b", "a", None) for r in order if r[1] == s]
    assert [tuple(r) for r in placed.orderBy("place").collect()] == [(*r, k) for k, r in enumerate(order)]
    sums = ranks.running(placed.withColumn("g", F.col("id") % 2), ["g"], "place", "n").collect()
    for r in sums:
        assert r["before"] == sum(n for k, (i, _, n) in enumerate(order) if i % 2 == r["g"] and k < r["place"])
    assert ranks.ranked(df.where("id < 0"), "s").collect() == []
    with pytest.raises(ValueError):
        ranks.ranked(placed, "s")


@pytest.mark.parametrize("narrow", [True, False])
def test_gallery_distance_equals_all_pairs(spark, narrow):
    """Alike galleries take the means, opposite ones are compared vector by vector; both give the mean over pairs."""
    rng = np.random.default_rng(4)
    rows = []
    for g in (1, 2):
        for m in range(5):
            base = np.eye(6)[m % 2] * (1 if narrow or m < 3 else -1)
            for _ in range(rng.integers(1, 7)):
                v = base + rng.normal(size=6) * (0.05 if narrow else 0.6)
                rows.append((g, m, int(rng.integers(0, 4)), (v / np.linalg.norm(v)).tolist()))
    df = spark.createDataFrame([*rows, (1, 0, 1, None)], "game int, m int, shape int, v array<double>")
    got = {(r["game"], r["a"], r["b"]): r["distance"] for r in vectors.gallery_distance(df, df, "m", "m", "v", ["game"], "shape").collect()}
    want = {}
    for g in (1, 2):
        for a in range(5):
            for b in range(a + 1, 5):
                each = [min(1.0, (1 - float(np.dot(p[3], q[3]))) / 2 + 0.2 * abs(p[2] - q[2]) / 3) for p in rows for q in rows if p[:2] == (g, a) and q[:2] == (g, b)]
                want[g, a, b] = sum(each) / len(each)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    pairs = spark.createDataFrame([(1, 3, 0)], "game int, a int, b int")
    (one,) = vectors.gallery_distance(df, df, "m", "m", "v", ["game"], "shape", pairs).collect()
    assert abs(one["distance"] - want[1, 0, 3]) < 1e-9


def test_seen_twice_equals_the_loop(spark):
    rng = random.Random(8)
    rows = [(g, m, f, x := rng.uniform(-40, 40), y := rng.uniform(0, 30), x + rng.uniform(5, 50), y + rng.uniform(5, 50)) for g in (1, 2) for m in range(6) for f in rng.sample(range(60), 25)]
    df = spark.createDataFrame(rows, "game int, m int, f int, x1 double, y1 double, x2 double, y2 double").repartition(3)
    got = {tuple(r)[:4]: r["overlap"] for r in detection.seen_twice(df, ["game"], "m", "f", ("x1", "y1", "x2", "y2"), 11.0, frames=12, share=0.5, least=0.12).collect()}
    want = {}
    for g in (1, 2):
        for a in range(6):
            for b in range(a + 1, 6):
                at = [{r[2]: r[3:] for r in rows if r[:2] == (g, m)} for m in (a, b)]
                shared = at[0].keys() & at[1].keys()
                over = []
                for f in shared:
                    p, q = at[0][f], at[1][f]
                    w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
                    i = max(0, w) * max(0, h)
                    over.append(i / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - i))
                if shared and len(shared) <= 12 and len(shared) <= 0.5 * min(map(len, at)) and sum(over) / len(over) >= 0.12:
                    want[g, a, b, len(shared)] = sum(over) / len(over)
    assert got.keys() == want.keys() and len(want) > 3 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    spans = df.groupBy("game", "m").agg(F.min("f").alias("s"), F.max("f").alias("e"))
    pairs = spark.createDataFrame([(1, 5, 0), (1, 0, 1)], "game int, a int, b int")
    twice = spark.createDataFrame([(1, 0, 5)], "game int, a int, b int")
    assert [tuple(r) for r in detection.bridged(spans, pairs, ["game"], "m", "s", "e", twice).collect()] == [(1, 5, 0, 0)]


def test_settled_removes_what_was_saved_on_the_way(spark):
    paths = []

    def saved(df):
        out = tables.saved(df)
        paths.append(out.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:"))
        return out

    def inner():
        return saved(spark.range(3)).selectExpr("id + 1 as id")

    def outer():
        return saved(tables.settled(spark, inner)).where("id > 1")

    got = tables.settled(spark, outer)
    assert sorted(r["id"] for r in got.collect()) == [2, 3]
    from pathlib import Path

    assert len(paths) == 2 and not any(Path(p.replace("//", "/")).exists() for p in paths)
    assert tables.saved(spark.range(2)).count() == 2


@pytest.mark.parametrize("rows", [3, 8192])
def test_gallery_match_equals_all_pairs(spark, rows):
    """Squares of three vectors or one square: nearest names with a margin, ties, missing vectors and a game without gallery."""
    rng = np.random.default_rng(rows)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    gallery = [(g, f"n{k % 4}", unit(rng.normal(size=3))) for g in (1, 2) for k in range(14)] + [(1, "tie", [1.0, 0.0, 0.0]), (1, "also", [1.0, 0.0, 0.0]), (2, "none", None)]
    queries = [(g, k, unit(rng.normal(size=3))) for g in (1, 2, 3) for k in range(20)] + [(1, 99, [1.0, 0.0, 0.0]), (2, 98, None)]
    q, g = spark.createDataFrame(queries, "game int, id int, v array<double>"), spark.createDataFrame(gallery, "game int, name string, v array<double>")
    for accept, margin in ((0.3, 0.08), (0.9, 0.0)):
        got = {tuple(r)[:3]: r["distance"] for r in vectors.gallery_match(q, g, "id", "v", "name", ["game"], accept, margin, rows=rows).collect()}
        want = {}
        for game, k, v in queries:
            best = {}
            for h, n, w in gallery:
                if h == game and v is not None and w is not None:
                    best[n] = min(best.get(n, 9.0), 1 - float(np.dot(v, w)))
            near = sorted((d, n) for n, d in best.items())
            if near and near[0][0] <= accept and (len(near) < 2 or near[1][0] - near[0][0] >= margin):
                want[game, k, near[0][1]] = near[0][0]
        assert got.keys() == want.keys() and len(want) > 5 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert vectors.gallery_match(q, g.where("game > 9"), "id", "v", "name", ["game"]).collect() == []


def rallies_by_loop(labels, live, window, gap, least, stride, frames):
    """Rallies of a list of labels, chunk by chunk."""
    smooth = []
    for k in range(len(labels)):
        some = labels[max(0, k - window // 2) : k + window // 2 + 1]
        smooth.append(max(some, key=lambda x: (some.count(x), -some.index(x))))
    found = []
    for k in (k for k, x in enumerate(smooth) if x in live):
        if found and k - found[-1][1] <= gap:
            found[-1][1] = k
        else:
            found.append([k, k])
    kept = [(a, z) for a, z in found if z - a + 1 >= least]
    return [(n, a * stride, min((z + 1) * stride, frames) - 1) for n, (a, z) in enumerate(kept)]


def test_status_parameters_shape_rallies(spark):
    rng = random.Random(6)
    films = {g: [x for _ in range(40) for x in [rng.choice(["no", "no", "play", "serve"])] * rng.randint(1, 6)] for g in range(6)}
    rows = [(g, k, x, 8 * len(xs) - g) for g, xs in films.items() for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "game long, chunk long, label string, frames long")
    seen = []
    for changes, window, gap, least in (({}, 5, 3, 4), ({"SMOOTHING_WINDOW_CHUNKS": 1}, 1, 3, 4), ({"MAX_GAP_SECONDS_WITHIN_RALLY": 0.2, "MIN_RALLY_DURATION_SECONDS": 3}, 5, 1, 9)):
        out = ordered.live_rallies(df, ["game"], "chunk", "label", ["no", "play", "serve"], ["play", "serve"], 24.0, 8, "frames", Params().patched({"game_status": changes}))
        got = sorted((r["game"], r["rally"], r["start_frame"], r["end_frame"]) for r in out.collect())
        assert got == sorted((g, *r) for g, xs in films.items() for r in rallies_by_loop(xs, ("play", "serve"), window, gap, least, 8, 8 * len(xs) - g))
        seen.append(got)
    assert len({len(s) for s in seen}) == 3 and ordered.live_rallies(df.where("false"), ["game"], "chunk", "label", ["no"], ["play"], 24.0, 8, "frames").collect() == []


def test_contact_parameters_gate_contacts(spark):
    """One contact of a ball at 10 m/s, 2 m from the nearest player: a smaller reach or top speed leaves it as it is."""
    points = [(1, 100 + k, 0.0, 0.0, 4.0 + (0.4 * k if k <= 0 else -0.4 * k), 4.0, None) for k in range(-6, 7)]
    pts = spark.createDataFrame(points, "game long, frame long, px double, py double, cx double, cy double, height double")
    hits = spark.createDataFrame([(1, 100, 94, 106, 0.0, 0.0)], "game long, frame long, low long, high long, px double, py double")
    players = spark.createDataFrame([(1, 100, 4.0, 6.0, 0.0, 0.0)], "game long, frame long, x double, y double, px double, py double")

    def moved(stage=None, **changes):
        p = Params().patched({stage: changes} if stage else {})
        return contacts.refined(hits, pts, players, ["game"], 25.0, 1000.0, params=p).collect()[0]["refined"]

    assert moved() and not moved("action_detection", MAX_PLAYER_ATTRIBUTION_DISTANCE_M=1.5) and moved("ball_detection", MAX_PLAUSIBLE_REPORTED_SPEED_MS=10.5)
    slow = pts.withColumn("cx", F.col("cx") * 3)
    assert contacts.refined(hits, slow, players.withColumn("x", F.col("x") * 3), ["game"], 25.0, 1000.0).collect()[0]["refined"]
    assert not contacts.refined(hits, slow, players.withColumn("x", F.col("x") * 3), ["game"], 25.0, 1000.0, params=Params().patched({"ball_detection": {"MAX_PLAUSIBLE_REPORTED_SPEED_MS": 20}})).collect()[0]["refined"]
