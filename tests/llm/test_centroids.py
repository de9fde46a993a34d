from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from matchlake.llm import centroids


def brute(rows, dim, n, rounds, scale=256):
    kept = [(k, tuple(math.floor(scale * float(np.float32(c))) for c in v)) for k, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:n]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda v: min((dist(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, of, strict=True) if a == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(k, *nearest(v)) for k, v in kept]
    inertia = {}
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    sha = lambda j: hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()
    return sorted(str((k, j, d, inertia[j], sum(inertia.values()), sha(j))) for k, d, j in found)


@pytest.mark.parametrize(("seed", "n", "grid"), [(1, 9, False), (2, 12, True)])
def test_equals_brute_force(spark, seed, n, grid):
    """grid: few different integer vectors, so that ties and repeated rows abound."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, size=(400, 4)) / 256 * 3 if grid else np.concatenate([rng.normal(size=4) * 3 + rng.normal(size=(50, 4)) for _ in range(8)])
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    rows += [rows[0], rows[5], (None, rows[7][1]), (900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan"), 1.0, 1.0, 1.0]), (905, [1.0, 1.0, float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, near int, kind string").repartition(3)
    told = []
    got = centroids.cluster(df, dim=4, centroids=n, rounds=5, told=told)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, 4, n, 5)
    assert len(told) == 5 and all(0 <= t <= len(rows) for t in told)


def test_bounds_spare_distances_and_stay_true():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-900, 900, size=8) + rng.integers(-40, 40, size=(100, 8)) for _ in range(30)])
    c = x[::100].copy() + rng.integers(-60, 60, size=(30, 8))
    state, scanned = centroids.first_bounds(x, c), []
    for _ in range(6):
        new = np.array([x[state[0] == k].sum(0) // max(1, (state[0] == k).sum()) if (state[0] == k).any() else c[k] for k in range(len(c))])
        *state, n = centroids.Moves(c, new).apply(x, *state)
        c = new
        d = centroids.squared(x, c)
        assert (state[0] == d.argmin(1)).all()
        assert (state[1] >= np.sqrt(d.min(1))).all() and (state[2] <= np.sqrt(np.sort(d, 1)[:, 1])).all()
        scanned.append(n)
    assert scanned[-1] < len(x) / 20


def test_large_components():
    x = np.array([[(1 << 26) - 1, 5], [-(1 << 26) + 1, -5]], np.int64)
    assert centroids.squared(x, x).tolist() == [[0, (2 * x[0][0]) ** 2 + 100], [(2 * x[0][0]) ** 2 + 100, 0]]


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(3)], "vec_id long, embedding array<double>")
    assert [r["distance"] for r in centroids.cluster(df, dim=2).collect()] == [0, 0, 0]
    assert centroids.cluster(df.where("vec_id > 7"), dim=2).collect() == []
    assert centroids.cluster(df, dim=64).collect() == []
    with pytest.raises(Exception, match="scaled components"):
        centroids.cluster(df.selectExpr("vec_id", "array(1e9D, 0D) as embedding"), dim=2).collect()
