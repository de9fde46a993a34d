"""Edges: nulls, ties, empty inputs and folds against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake import catalog, params
from matchlake.functions import scalars
from matchlake.operators import asof, detection, graph, intervals, ordered, quality, spatial, stats, upserts, vectors


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_null_aware_scalars(spark):
    df = spark.createDataFrame([(2.0, None), (None, None), (-1.0, 0.5)], "a double, b double")
    got = df.select(scalars.clamp01(F.col("a")), scalars.weighted_score({"x": F.col("a"), "y": F.col("b")}, {"x": 1.0, "y": 3.0})).collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0), (None, None), (0.0, 0.125)]
    assert scalars.redistributed({"a": 0.5, "b": 0.25, "c": 0.25}, "a", 0.2) == {"a": 0.2, "b": 0.4, "c": 0.4}
    assert scalars.redistributed({"a": 1.0, "b": 0.0, "c": 0.0}, "a", 0.4) == {"a": 0.4, "b": 0.3, "c": 0.3}


def test_homography_maps_corners(spark):
    src, dst = [(10, 20), (200, 25), (220, 150), (5, 140)], [(0, 0), (18, 0), (18, 9), (0, 9)]
    h = spatial.homography(src, dst)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in src], "x double, y double")
    u, v = scalars.project(h, F.col("x"), F.col("y"))
    assert [(round(a, 6) + 0, round(b, 6) + 0) for a, b in df.select(u, v).collect()] == dst


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([("g", 10, 1), ("g", 3, 2), ("g", 99, 3), ("h", 5, 4)], "k string, t int, id int")
    right = spark.createDataFrame([("g", 8, "a"), ("g", 12, "b"), ("g", 4, "c")], "k string, t int, v string")
    near = asof.nearest(left, right, ["k"], "t", "t", ["v"], within=5)
    assert sorted((r["id"], r["asof_v"]) for r in near.collect()) == [(1, "a"), (2, "c"), (3, None), (4, None)]
    back = asof.backward(left, right, ["k"], "t", "t", ["v"])
    assert sorted((r["id"], r["asof_v"]) for r in back.collect()) == [(1, "a"), (2, None), (3, "b"), (4, None)]
    ahead = asof.forward(left, right, ["k"], "t", "t", ["v"], within=2)
    assert sorted((r["id"], r["asof_v"]) for r in ahead.collect()) == [(1, "b"), (2, "c"), (3, None), (4, None)]


def test_separated_equals_a_loop(spark):
    rng = random.Random(4)
    data = [(g, float(t), rng.choice([None, 1.0, 2.0, 3.0])) for g in range(5) for t in sorted(rng.sample(range(200), 40))]
    want = []
    for g in range(5):
        kept = []
        for _, t, s in [r for r in data if r[0] == g]:
            if not kept or t - kept[-1][1] > 7:
                kept.append((g, t, s))
            elif (s or 0) > (kept[-1][2] or 0):
                kept[-1] = (g, t, s)
        want += kept
    got = ordered.separated(spark.createDataFrame(data, "g int, t double, s double"), ["g"], "t", "s", 7)
    assert sorted(map(str, rows_of(got))) == sorted(map(str, want))


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_merged_windows_equal_a_loop(spark):
    rng = random.Random(9)
    data = [(g, s, s + rng.randint(0, 12)) for g in range(4) for s in rng.sample(range(300), 25)]
    want = []
    for g in range(4):
        last = None
        for s, e in sorted((max(0, s - 3), e) for h, s, e in data if h == g and e > max(0, s - 3)):
            if last and s <= last[1] + 1:
                last[1] = max(last[1], e)
            else:
                last = [s, e]
                want.append((g, last))
    got = intervals.merged(spark.createDataFrame(data, "g int, s int, e int"), ["g"], "s", "e", 3, 1)
    assert rows(got) == sorted((g, *w) for g, w in want)


def test_hermite_and_line_fill(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 4, 4.0), (1, 5, 5.0), (1, 40, 9.0)], "g int, t int, v double")
    got = {r["t"]: (round(r["v"], 6), r["interpolated"]) for r in ordered.hermite_filled(df, ["g"], "t", "v", damping=1.0).collect()}
    assert got[2] == (2.0, True) and got[3] == (3.0, True) and got[4] == (4.0, False) and 6 not in got


def test_cliques_need_all_pairs(spark):
    edges = [(1, "a", "b", 0.9), (1, "b", "c", 0.8), (1, "a", "c", 0.7), (1, "c", "d", 0.95), (2, "x", "y", 0.51234), (2, "y", "z", 0.4)]
    got = rows(graph.clique_groups(spark.createDataFrame(edges, "game int, a string, b string, s double"), "game", "a", "b", "s"))
    assert got == [(1, "a", "a", 0.9), (1, "b", "a", 0.9), (1, "c", "c", 0.95), (1, "d", "c", 0.95), (2, "x", "x", 0.512), (2, "y", "x", 0.512)]


def test_agglomeration_respects_time(spark):
    nodes = [(1, 1, [1.0, 0.0], 0, 5), (1, 2, [1.0, 0.01], 6, 9), (1, 3, [1.0, 0.0], 2, 4), (1, 4, [0.0, 1.0], 20, 30)]
    got = rows(graph.agglomerated(spark.createDataFrame(nodes, "game int, id int, v array<double>, start int, end int"), "game", "id", "v", 0.2))
    assert got in ([(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 4)], [(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 4)])


def test_agglomeration_merges_the_nearest_first(spark):
    rng = np.random.default_rng(5)
    at = rng.normal(size=(60, 3)).round(3)
    begin = [int(v) for v in rng.integers(0, 300, 60)]
    clusters = {k: ([k], at[k]) for k in range(60)}
    clash = lambda a, b: any(begin[i] <= begin[j] + 9 and begin[j] <= begin[i] + 9 for i in a for j in b)
    cost = lambda x, y: (1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) / 2
    while True:
        pairs = [(cost(clusters[x][1], clusters[y][1]), x, y) for x in clusters for y in clusters if x < y and not clash(clusters[x][0], clusters[y][0])]
        if not pairs or min(pairs)[0] > 0.2:
            break
        _, x, y = min(pairs)
        other = clusters.pop(y)
        clusters[x] = (clusters[x][0] + other[0], clusters[x][1] + other[1])
    df = spark.createDataFrame([(1, k, [float(v) for v in at[k]], begin[k], begin[k] + 9) for k in range(60)], "game int, id int, v array<double>, start int, end int")
    assert rows(graph.agglomerated(df, "game", "id", "v", 0.2)) == sorted((1, n, x) for x, (ns, _) in clusters.items() for n in ns)


def test_clusters_cover_all_vectors(spark):
    d = "/root/testdata/sf0.001"
    got = catalog.queries()["identity_clusters"](spark, d)
    assert got.select("node").distinct().count() == spark.read.parquet(f"{d}/embeddings.parquet").count()


def test_whole_tables_have_queries(spark):
    d = "/root/testdata/sf0.001"
    sizes = [n for (n,) in spark.read.parquet(f"{d}/embeddings.parquet").groupBy("label").count().select("count").collect()]
    assert catalog.queries()["appearance_distances_all"](spark, d).count() == sum(n * (n - 1) // 2 for n in sizes)
    for name in ("gallery_match", "speed_labels"):
        part, whole = catalog.queries()[name](spark, d), catalog.queries()[name + "_all"](spark, d)
        assert part.exceptAll(whole).count() == 0 and whole.count() > part.count()


def test_candidates_pass_every_gate(spark):
    """1 and 2 match; 3 overlaps 1 and 2 in time, 4 shares no zone, 5 is on the other side, 6 looks different, 7 has no vector."""
    spans = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 6, 9), (1, 3, 4, 7), (1, 4, 20, 25), (1, 5, 30, 35), (1, 6, 40, 45), (1, 7, 50, 55), (2, 8, 60, 65)], "g int, m int, s int, e int")
    spots = {1: [(1, "A"), (2, "A")], 2: [(1, "A")], 3: [(1, "A")], 4: [(9, "A")], 5: [(1, "B"), (2, "B")], 6: [(1, "A")], 7: [(1, "A")], 8: [(1, "A")]}
    places = spark.createDataFrame([(1 + (m == 8), m, z, s) for m, at in spots.items() for z, s in at], "g int, m int, zone int, side string")
    looks = {m: [1.0, 0.0] for m in (1, 2, 3, 4, 5, 8)} | {6: [-1.0, 0.0], 7: None}
    gallery = spark.createDataFrame([(1 + (m == 8), m, v, m % 2) for m, v in looks.items()], "g int, m int, v array<double>, bin int")
    got = rows(detection.candidate_matches(spans, places, gallery, ["g"], "m", "s", "e", "zone", "side", "v", "bin"))
    assert [(g, a, b, round(x, 6)) for g, a, b, x in got] == [(1, 1, 2, round(0.2 / 3, 6))]
    far = vectors.gallery_distance(gallery, gallery, "m", "m", "v", ["g"], "bin").where("a = 1 and b = 6").collect()
    assert [r["distance"] for r in far] == [1.0]


def test_scoreboard_machine(spark):
    reads = [(0, 0), (1, 0), (None, 1), (2, 1), (3, 2), (0, 1), (1, None)]
    df = spark.createDataFrame([("g", k, a, b) for k, (a, b) in enumerate(reads)], "game string, n int, l int, r int")
    got = [tuple(x)[2:] for x in graph.scoreboard(df, "game", "n", "l", "r").orderBy("n").collect()]
    assert got == [(None, 0), ("left", 0), ("right", 0), ("left", 0), (None, 0), ("right", 1), ("left", 1)]


def test_parabola_and_line(spark):
    df = spark.createDataFrame([(1, float(t), 2.0 * t * t - 3 * t + 5) for t in range(6)] + [(2, 1.0, 1.0)], "g int, t double, v double")
    got = {r["g"]: r for r in stats.fit_parabola(df, ["g"], "t", "v").collect()}
    assert [round(got[1][k], 6) for k in "abc"] == [2.0, -3.0, 5.0] and got[2]["a"] is None


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    changes = spark.createDataFrame([(2, "B"), (3, " "), (4, "d")], "id int, name string")
    assert rows(upserts.upserted(base, changes, ["id"], scalars.named(F.col("name")).isNull())) == [(1, "a"), (2, "B"), (4, "d")]
    first = spark.createDataFrame([("Ann ",), ("bob",), (" ",)], "n string")
    assert rows(upserts.union_ignoring_case([first, spark.createDataFrame([("ANN",), ("Cy",)], "n string")], "n")) == [("Ann",), ("Cy",), ("bob",)]
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, {"x": "1"})], "s map<string,string>, c map<string,string>")
    assert [r[0] for r in df.select(upserts.patched(F.col("s"), F.col("c"))).collect()] == [{"a": "1", "b": "3"}, {"x": "1"}]


def test_alternation_and_sets(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, "x"), (1, 2, None), (1, 3, None), (2, 0, None)], "g int, n int, v string")
    assert [r["v"] for r in ordered.alternation(df, ["g"], "n", "v", {"x": "y", "y": "x"}).orderBy("g", "n").collect()] == ["y", "x", "y", "x", None]
    s = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (1, 3, True), (1, 4, False)], "g int, n int, cut boolean")
    assert [r["set_index"] for r in ordered.set_numbers(s, ["g"], ["n"], F.col("cut")).orderBy("n").collect()] == [0, 0, 1, 1, 2]


def test_registry_and_profiles():
    p = params.Profiles()
    p.create("mine", "Mine")
    p.update("mine", changes={"ball_detection": {"MIN_SELECT_CONFIDENCE": 0.7}, "transcoding": {"PRESET": "slow"}})
    p.update("mine", changes={"ball_detection": {"MAX_INTERPOLATE_GAP_FRAMES": 10}})
    assert p.sets["mine"][1].get("ball_detection", "MIN_SELECT_CONFIDENCE") == 0.7 and p.sets["mine"][1].get("ball_detection", "MAX_INTERPOLATE_GAP_FRAMES") == 10
    p.activate("mine")
    p.delete("mine")
    assert p.active == p.DEFAULT
    for bad in ({"nope": {}}, {"transcoding": {"CRF": 99}}, {"transcoding": {"PRESET": "x"}}, {"transcoding": {"CRF": True}}, {"game_status": {"x": 1}}):
        with pytest.raises(params.ParamError):
            params.validated(bad)
    with pytest.raises(params.ParamError):
        p.update(p.DEFAULT, name="x")
    assert abs(sum(params.Params().weights("SERVE_WEIGHTS").values()) - 1) < 1e-9


def test_quality_renormalises_over_known_factors(spark):
    cols = "action_type string, x double, y double, speed_in double, speed_out double, gap double, apex double, height double, prev_x double, prev_y double, set_x double, set_y double, spike_x double, spike_y double, opponent_distance double, blockers int"
    nothing = [None] * 15
    serve = ["serve", None, None, None, 10.0, *[None] * 11]
    dig = ["dig", 1.0, 1.0, 0.0, 4.0, 1.0, None, None, 0.0, 0.0, 1.0, 1.0, None, None, None, None]
    got = [r["score"] for r in quality.scored(spark.createDataFrame([tuple(serve), tuple(dig), ("hit", *nothing), ("set", *nothing)], cols)).collect()]
    assert got[0] == 0.5 and abs(got[1] - (0.35 * 1 + 0.35 * 0.5) / 0.7) < 1e-9 and got[2] is None and got[3] is None


def test_tracklets_are_cut_by_gaps_and_jumps(spark):
    a, b = [1.0, 0.0], [-1.0, 0.0]
    data = [(1, 7, f, v) for f, v in [(0, a), (1, a), (2, a), (3, b), (4, b), (9, b), (10, None), (11, a)]]
    got = [r["part"] for r in graph.chained(spark.createDataFrame(data, "g int, t int, f int, v array<double>"), "g", "t", "f", "v").orderBy("f").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 2]


def test_dataset_keeps_a_training_row(spark):
    one = spark.createDataFrame([(1, 0)], "id int, label int")
    got = upserts.dataset({"x": one, "y": one.where("false")}, "id", "label", {"x": {0: 3}, "y": {0: 1}}, 0.9, 1).collect()
    assert [tuple(r) for r in got] == [("x/1", 3, "x", "train")]


def test_rally_override(spark):
    games = spark.createDataFrame([("a", 30.0, 60.0), ("b", 25.0, 10.0)], "game string, fps double, duration_s double")
    given = spark.createDataFrame([("a", 20.0, 30.0), ("a", 1.0, 2.5), ("b", 1.0, 3.0), ("b", 2.0, 4.0), ("b", 5.0, 11.0), ("b", 9.0, 8.0)], "game string, start_time_s double, end_time_s double")
    good, faults = upserts.rallies_overridden(given, games)
    assert [tuple(r)[:4] for r in good.orderBy("rally_index").collect()] == [("a", 0, 30, 75), ("a", 1, 600, 900)]
    assert sorted((r["start_time_s"], r["fault"]) for r in faults.collect()) == [(2.0, "overlaps the one before"), (5.0, "ends after the game"), (9.0, "ends before it begins")]


def test_means_at_a_limit_dont_depend_on_how_rows_are_dealt(spark):
    values = [[round(rng.uniform(0, 18), 2) + 0.07 * k for k in range(64)] for rng in map(random.Random, range(40))]
    df = spark.createDataFrame([(g, k, x) for g, own in enumerate(values) for k, x in enumerate(own)], "g int, k int, x double")
    want = []
    for g, own in enumerate(values):
        total = 0.0
        for x in own:
            total += x
        want.append((g, total / 64, 64, "A" if total / 64 < 9.0 else "B"))
    for dealt in (df.repartition(1), df.repartition(7), df.orderBy(F.desc("k"))):
        assert rows(stats.sides(dealt, ["g"], "x", ["k"])) == want


def test_profiles_take_sides_in_the_order_of_touches(spark, tmp_path):
    import datetime

    import duckdb

    rng, start, made = random.Random(3), datetime.datetime(2024, 1, 1), []
    for player in range(60):  # means of nine but for the last digits
        cents = [rng.randint(0, 1799) for _ in range(19)]
        cents = [c for c in cents if 0 <= 1800 - c < 1800 and c] + [1800 - c for c in cents if c]
        rng.shuffle(cents)
        for k, c in enumerate([500, *cents]):
            made.append((0 if not k else 90_000 + 100 * k + player, player, c / 100 + 18.0 * rng.randint(0, 9)))
    made = [(i, start + datetime.timedelta(seconds=t), u, "purchase", v, '{"k": 5}') for i, (t, u, v) in enumerate(sorted(made))]
    df = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.repartition(8, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"set TimeZone = 'UTC'; create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet') order by event_id")
    assert rows(catalog.queries()["profile_rollup"](spark, str(tmp_path))) == sorted(c.execute(catalog.oracle_sql()["profile_rollup"]).fetchall())


def test_all_pairs_in_squares_keep_missing_vectors(spark):
    rng = np.random.default_rng(5)
    made = {(g, k): rng.normal(size=3).tolist() for g in "xy" for k in range(30)}
    made |= {("x", 30): None, ("x", 31): [1.0, None, 2.0], ("z", 1): None, ("z", 2): None, ("w", 1): [1.0, 0.0, 0.0]}
    df = spark.createDataFrame([(*k, v) for k, v in made.items()], "g string, k int, v array<float>")
    got = {(r.g, r.a, r.b): r.s for r in vectors.similar_pairs(df, ["g"], "k", "v", rows=7).collect()}
    want = {(g, a, b): (p, q) for (g, a), p in made.items() for (h, b), q in made.items() if g == h and a < b}
    assert got.keys() == want.keys()
    for pair, (p, q) in want.items():
        if p is None or q is None or None in p + q:
            assert np.isnan(got[pair])
        else:
            assert abs(got[pair] - np.float32(p).astype(float) @ np.float32(q).astype(float)) < 1e-12
    assert rows(vectors.similar_pairs(df, ["g"], "k", "v", 0.5, rows=7).select("g", "a", "b")) == sorted(k for k, s in got.items() if s > 0.5)


def test_least_gaps_against_a_loop(spark):
    rng = random.Random(8)
    spans = [(g, rng.randrange(9), s, s + rng.choice([0, 3, 40, 700])) for g in range(4) for s in (rng.randrange(3000) for _ in range(25))]
    best = {}
    for g, m, s, e in spans:
        for h, n, t, u in spans:
            if g == h and m < n:
                best[g, m, n] = min(best.get((g, m, n), 10**9), max(s - u, t - e))
    df = spark.createDataFrame(spans, "g int, m int, s int, e int")
    for wide in (1, 16):
        assert rows(intervals.least_gaps(df, ["g"], "m", "s", "e", 20, wide)) == sorted((*k, v) for k, v in best.items() if 0 < v <= 20)


def test_gaps_of_all_pairs_against_bridged(spark):
    rng = random.Random(4)
    spans = [(g, rng.choice("abcdefg"), s, s + rng.choice([0, 5, 60])) for g in (1, 2, 3) for s in (rng.randrange(2000) for _ in range(20))]
    df = spark.createDataFrame([*spans, (4, "a", 1, 2), (None, "a", 1, 2), (None, "b", 5, 6)], "g int, m string, s int, e int")
    ids = df.select("g", "m").distinct()
    pairs = ids.withColumnRenamed("m", "a").join(ids.withColumnRenamed("m", "b"), "g").where("a < b")
    twice = spark.createDataFrame([(1, "b", "a"), (1, "c", "f"), (2, "a", "g"), (3, "a", "zz")], "g int, a string, b string")
    assert rows(detection.gaps(df, ["g"], "m", "s", "e")) == rows(detection.bridged(df, pairs, ["g"], "m", "s", "e"))
    assert rows(detection.gaps(df, ["g"], "m", "s", "e", twice)) == rows(detection.bridged(df, pairs, ["g"], "m", "s", "e", twice))


def test_candidate_matches_in_squares_against_a_loop(spark, monkeypatch):
    rng, gen = random.Random(6), np.random.default_rng(6)
    spans = [(g, m, s, s + rng.randrange(1, 30)) for g in "xy" for m in range(24) for s in (rng.randrange(400) for _ in range(rng.choice([1, 1, 2])))]
    places = [(g, m, rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "A", "B", "B"])) for g in "xy" for m in range(24) for _ in range(rng.choice([0, 1, 4]))]
    units = gen.normal(size=(120, 3))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    looks = [(rng.choice("xy"), rng.randrange(24), v.tolist(), rng.randrange(4)) for v in units] + [("x", 3, None, 1), ("z", 1, [1.0, 0.0, 0.0], 0)]
    twice = [("x", 9, 4), ("y", 1, 2), ("x", 0, 99)]
    a, b, c = (spark.createDataFrame(r, t) for r, t in ((spans, "g string, m int, s int, e int"), (places, "g string, m int, zone int, side string"), (looks, "g string, m int, v array<double>, bin int")))
    t = spark.createDataFrame(twice, "g string, a int, b int")
    want = {}
    for g in "xy":
        for p in range(24):
            for q in range(p + 1, 24):
                gap = min(max(s - u, w - e) for h, m, s, e in spans if (h, m) == (g, p) for k, n, w, u in spans if (k, n) == (g, q))
                zones = [[z for h, m, z, _ in places if (h, m) == (g, k) and z is not None] for k in (p, q)]
                sides = [[s for h, m, _, s in places if (h, m) == (g, k) and s] for k in (p, q)]
                share = sum(min(zones[0].count(z) / len(zones[0]), zones[1].count(z) / len(zones[1])) for z in range(4)) if all(zones) else 1
                most = ["A" if s.count("A") >= s.count("B") else "B" for s in sides]
                apart = all(sides) and most[0] != most[1] and all(s.count(o) / len(s) >= 0.7 for s, o in zip(sides, most, strict=True))
                d = [min(1.0, min(1.0, max(0.0, (1 - np.dot(v, w)) / 2)) + 0.2 * abs(i - j) / 3) for h, m, v, i in looks if (h, m) == (g, p) and v for k, n, w, j in looks if (k, n) == (g, q) and w]
                if d and (gap > 0 or (g, q, p) in twice or (g, p, q) in twice) and 1 - share <= 0.95 and not apart and np.mean(d) <= 0.5:
                    want[g, p, q] = np.mean(d)
    assert len(want) > 40
    for members, held in ((256, 4096), (5, 4096), (256, 20)):
        monkeypatch.setattr(detection, "SQUARE", members)
        monkeypatch.setattr(detection, "SQUARE_LOOKS", held)
        got = {(r.g, r.a, r.b): r.distance for r in detection.candidate_matches(a, b, c, ["g"], "m", "s", "e", "zone", "side", "v", "bin", confident=0.7, most=0.5, twice=t).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - d) < 1e-9 for k, d in want.items())
