"""Order-dependent queries and operators against plain loops."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from matchlake import catalog
from matchlake.operators import graph, intervals, members, vectors
from matchlake.plans import flights, rollups
from matchlake.plans.bindings import touches

DIR = "/root/testdata/sf0.001"


def test_scoreboard_query(spark):
    got = sorted(tuple(r) for r in catalog.queries()["scoreboard_fsm"](spark, DIR).collect())
    games = defaultdict(list)
    for r in touches(spark, DIR).orderBy("game", "frame", "touch_id").collect():
        games[r["game"]].append(r["x"])
    want = []
    for game, xs in games.items():
        a = b = sets = 0
        for n, _ in enumerate(xs):
            up = sum(x < 9.0 for x in xs[n - n % 20 : n + 1])
            left, right = (up if n % 7 else None), (n % 20 + 1 - up if n % 11 else None)
            if (left is not None and left < a) or (right is not None and right < b):
                a, b, sets = 0, 0, sets + 1
            one, two = left is not None and left > a, right is not None and right > b
            want.append((game, n, "left" if one and not two else "right" if two and not one else None, sets))
            a, b = a if left is None else left, b if right is None else right
    assert got == sorted(want, key=lambda r: r[:2]) and len(got) == 1000


def test_seeded_scoreboard(spark):
    known = spark.createDataFrame([(1, n, n // 4, w) for n, w in enumerate(["left", "left", None, "right", "left", "right", "left", "left"])], "game long, n long, set_index long, winner string")
    seeds = graph.seed_scores(known, "game", "n", "set_index", "winner", spark.createDataFrame([(1, 7)], "game long, at long"))
    assert [tuple(r) for r in seeds.collect()] == [(1, 2, 1)]
    readings = spark.createDataFrame([(1, 7, 3, 1), (1, 8, 3, 2), (2, 0, 1, 0)], "game long, n long, left int, right int")
    got = sorted(tuple(r) for r in graph.scoreboard(readings, "game", "n", "left", "right", seeds).collect())
    assert got == [(1, 7, "left", 0), (1, 8, "right", 0), (2, 0, "left", 0)]


def test_tracklet_query(spark):
    got = sorted(tuple(r) for r in catalog.queries()["tracklet_chains"](spark, DIR).collect())
    tracks = defaultdict(list)
    for r in spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect():
        tracks[r["label"]].append((r["vec_id"], np.array(r["embedding"], float)))
    want = []
    for label, rows in tracks.items():
        part, kept, last = 0, [], None
        for f, v in rows:
            mean = sum(kept) if kept else None
            far = len(kept) >= 3 and (1 - mean @ v / np.linalg.norm(mean) / np.linalg.norm(v)) / 2 > 0.45
            if last is not None and (f - last > 25 or far):
                part, kept = part + 1, []
            kept.append(v)
            last = f
            want.append((label % 2, label, f, part))
    assert got == sorted(want) and max(r[3] for r in got) > 0


def test_cluster_query(spark):
    rows = catalog.queries()["identity_clusters"](spark, DIR).collect()
    got = {r["vec_id"] if "vec_id" in r else r["node"]: r["cluster"] for r in rows}
    by = defaultdict(list)
    for r in spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect():
        by[r["label"]].append((r["vec_id"], np.array(r["embedding"], float)))
    for nodes in by.values():
        clusters = [([i], v) for i, v in nodes]
        while True:
            best = None
            for x in range(len(clusters)):
                for y in range(x + 1, len(clusters)):
                    a, b = clusters[x], clusters[y]
                    if any(abs(i - j) * 3 <= 20 for i in a[0] for j in b[0]):
                        continue
                    d = min(1.0, max(0.0, (1 - a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1])) / 2))
                    if best is None or d < best[0] - 1e-12:
                        best = (d, x, y)
            if best is None or best[0] > 0.2:
                break
            _, x, y = best
            clusters[x] = (clusters[x][0] + clusters[y][0], clusters[x][1] + clusters[y][1])
            del clusters[y]
        for ids, _ in clusters:
            assert {got[i] for i in ids} == {min(ids)}


def test_hermite_query(spark):
    got = {(r["game"], r["hour"]): (r["v"], r["interpolated"]) for r in catalog.queries()["hermite_gaps"](spark, DIR).collect()}
    games = defaultdict(lambda: defaultdict(list))
    for r in touches(spark, DIR).collect():
        games[r["game"]][r["frame"] // 3600].append(r["speed"])
    want = {}
    for game, hours in games.items():
        t = sorted(hours)
        v = [sum(hours[h]) / len(hours[h]) for h in t]
        want |= {(game, h): (x, False) for h, x in zip(t, v, strict=True)}
        slope = [(v[k + 1] - v[k]) / (t[k + 1] - t[k]) for k in range(len(t) - 1)]
        for k, m in enumerate(slope):
            span = t[k + 1] - t[k]
            if not 2 <= span <= 21:
                continue
            m0, m1 = (slope[k - 1] if k else 0.0) * 0.6 * span, (slope[k + 1] if k + 1 < len(slope) else 0.0) * 0.6 * span
            for h in range(t[k] + 1, t[k + 1]):
                s = (h - t[k]) / span
                curve = np.polyval([2 * v[k] - 2 * v[k + 1] + m0 + m1, -3 * v[k] + 3 * v[k + 1] - 2 * m0 - m1, m0, v[k]], s)
                want[(game, h)] = (float(curve), True)
    assert got.keys() == want.keys() and any(i for _, i in want.values())
    assert all(abs(got[k][0] - x) < 1e-5 and got[k][1] == i for k, (x, i) in want.items())


def cliques(edges, shared, names):
    link, of = {}, {}
    for a, b, s in edges:
        of[a], of[b] = {a}, {b}
        if (min(a, b), max(a, b)) not in shared:
            link[(min(a, b), max(a, b))] = s
    for a, b in sorted(link, key=lambda p: (-link[p], p)):
        x, y = of[a], of[b]
        said = [{names[n] for n in g if names.get(n)} for g in (x, y)]
        if x is y or (said[0] and said[1] and said[0] != said[1]) or any((min(u, v), max(u, v)) not in link for u in x for v in y):
            continue
        for n in y:
            of[n] = x
        x |= y
    return {(n, min(g)) for n, g in of.items() if len(g) > 1}


def test_groups_with_vetoes(spark):
    rng = random.Random(4)
    for trial in range(3):
        edges = list({(min(a, b), max(a, b)): round(rng.random(), 3) for a, b in ((rng.randint(0, 14), rng.randint(0, 14)) for _ in range(90)) if a != b}.items())
        edges = [(a, b, s) for (a, b), s in edges]
        shared = {(a, b) for a, b, _ in edges if rng.random() < 0.15}
        names = {n: rng.choice(["ann", "bo", None, None]) for n in range(15)}
        got = graph.clique_groups(spark.createDataFrame([(1, *e) for e in edges], "game long, a long, b long, s double"), "game", "a", "b", "s", spark.createDataFrame([(1, b, a) for a, b in shared], "game long, a long, b long"), spark.createDataFrame([(1, n, v) for n, v in names.items()], "game long, node long, name string"))
        assert {(r["node"], r["group"]) for r in got.collect()} == cliques(edges, shared, names), trial


def vectors_by_label():
    out = defaultdict(list)
    for i, label, v in duckdb.sql(f"select vec_id, label, embedding from '{DIR}/embeddings.parquet' order by vec_id").fetchall():
        out[label].append((i, np.array(v, float)))
    return out


def test_look_alike_groups_query(spark):
    want = set()
    for label, some in vectors_by_label().items():
        edges = [(i, j, x @ y) for k, (i, x) in enumerate(some) for j, y in some[k + 1 :] if x @ y > 0.2]
        want |= {(label, n, g) for n, g in cliques(edges, set(), {})}
    got = rollups.look_alike_groups(spark, DIR).collect()
    assert {(r["label"], r["node"], r["group"]) for r in got} == want and len(want) > 20
    assert all(0.2 <= r["confidence"] < 0.6 for r in got)


def test_identity_cliques_of_copies(spark, tmp_path):
    """Three near copies and a pair in one label, a copy in another one; nulls and repeated rows pair with nothing new."""
    rng = np.random.default_rng(3)
    x, y = (v / np.linalg.norm(v) for v in rng.normal(size=(2, 16)))
    near = lambda v: [float(c) for c in v + rng.normal(size=16) * 0.01]
    rows = [(1, 1, near(x)), (2, 1, near(x)), (3, 1, near(x)), (4, 1, near(y)), (9, 1, near(y)), (7, 2, near(x)), (None, 1, near(x)), (8, 1, None), (10, 1, [None] * 16)]
    spark.createDataFrame([*rows, rows[0]], "vec_id long, label long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["label"], r["node"], r["group"]) for r in rollups.identity_cliques(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 4), (1, 9, 4)}


def test_similar_pairs_in_squares(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 7 > 1, k, [float(c) for c in rng.normal(size=3)]) for k in range(150)]
    df = spark.createDataFrame(rows, "hot boolean, id long, v array<double>")
    want = {(h, i, j) for h, i, u in rows for g, j, v in rows if h == g and i < j and np.dot(u, v) > 1.5}
    for size in (4096, 20):
        got = [(r["hot"], r["a"], r["b"]) for r in vectors.similar_pairs(df, ["hot"], "id", "v", 1.5, size).collect()]
        assert len(got) == len(want) and set(got) == want
    assert vectors.similar_pairs(df.where("false"), ["hot"], "id", "v", 1.5).collect() == []


def test_cliques_of_chains_need_no_game_in_one_task(spark):
    """Many small components of one game, loops, repeated, null and numberless edges."""
    edges = [(1, 10 * k + u, 10 * k + v, 0.5 + 0.01 * u) for k in range(50) for u, v in ((0, 1), (1, 2), (0, 2), (2, 3))]
    odd = [(1, 5, 5, 0.9), (1, 0, 1, 0.1), (1, None, 7, 0.9), (1, 0, 9, None), (1, 0, 9, float("nan")), (None, 1, 2, 0.9)]
    made = graph.clique_groups(spark.createDataFrame(edges + odd, "game long, a long, b long, s double"), "game", "a", "b", "s")
    got = {(r["node"], r["group"]) for r in made.collect()}
    assert got == cliques([e[1:] for e in edges], set(), {})
    assert graph.clique_groups(spark.createDataFrame([], "game long, a long, b long, s double"), "game", "a", "b", "s").collect() == []


def test_review_groups_query(spark):
    rows = flights.review_groups(spark, DIR).collect()
    size = Counter((r["game"], r["group"]) for r in rows)
    assert rows and min(size.values()) > 1


def test_refined_contacts_moves_some(spark):
    done = Counter(r["refined"] for r in flights.refined_contacts(spark, DIR).collect())
    assert done[True] and done[False]


def test_gallery_keeps_isolated_or_spread(spark):
    rows = [(1, k, 0, k % 5 if b else 3, b) for b in (0, 1) for k in range(100 * b, 100 * b + 23)]
    df = spark.createDataFrame([(g, i, b, s) for g, i, _, s, b in rows], "game long, id long, bucket long, isolation long")
    clusters = df.select("game", "id", F.lit(0).alias("cluster"))
    got = defaultdict(list)
    for r in members.merged_gallery(df, clusters, ["game"], "id", "bucket", "isolation", ["id"]).collect():
        got[r["bucket"]].append(r["id"])
    flat = [i for _, i, _, _, b in rows if b == 0]
    assert sorted(got[0]) == [flat[k] for k in sorted(set(np.linspace(0, 22, 10).round().astype(int)))]
    best = sorted((i for _, i, _, _, b in rows if b == 1), key=lambda i: (-(i % 5), i))[:10]
    assert sorted(got[1]) == sorted(best)


def test_dense_log_and_positions(spark):
    df = spark.createDataFrame([(1, f) for f in (0, 30, 60, 61, 90, 150)], "game long, frame long")
    out = intervals.dense_rebased(df, ["game"], "frame", 30.0, F.lit(1.0), F.lit(3.0))
    assert sorted((r["frame"], round(r["time"], 6)) for r in out.collect()) == [(0, 0.0), (1, 1.0), (2, 1.033333), (3, 2.0)]
