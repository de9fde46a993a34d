from __future__ import annotations

import numpy as np
import pytest

from matchlake.llm import cover_tree


def brute(rows, link=0.95):
    good = [(k, np.array(v, float)) for k, v in rows if k is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    n = len(good)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    count = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = good[i][1], good[j][1]
            if len(a) == len(b) and (a @ b) / np.linalg.norm(a) / np.linalg.norm(b) >= link:
                count[i] += 1
                count[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(good):
        least[find(i)] = min(k, least.get(find(i), k))
    out = [(k, c, least[find(i)], k == least[find(i)]) for i, ((k, _), c) in enumerate(zip(good, count, strict=True))]
    used = {id(v) for _, v in []}
    rest = [(k, v) for k, v in rows if not (k is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v))]
    return sorted(out + [(k, 0, k, True) for k, _ in rest], key=str), used


@pytest.mark.parametrize(("block", "structured"), [(4096, False), (40, True), (16, False), (16, True)])
def test_equals_brute_force(spark, monkeypatch, block, structured):
    rng = np.random.default_rng(block + structured)
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    base = rng.normal(size=(60, 8 if not structured else 3))
    rows = [v.tolist() for v in base]
    for v in base[:25]:
        for _ in range(rng.integers(1, 6)):
            rows.append((v + rng.normal(size=len(v)) * 0.12).tolist())
    rows += [rows[0]] * 12 + [[2 * c for c in rows[1]]]
    rows = [np.float32(v).tolist() for v in rows]
    data = [(i, v) for i, v in enumerate(rows)]
    width = len(rows[0])
    data += [(1000, None), (1001, [0.0] * width), (1002, [float("nan")] * width), (1003, [None, *[1.0] * (width - 1)]), (1004, [1.0, 0.0]), (1005, [1.0, 0.0]), (1006, []), (1007, [float("inf")] * width), (None, rows[2])]
    df = spark.createDataFrame([(k, v, 1) for k, v in data], "vec_id long, embedding array<float>, node int").repartition(3)
    got = sorted([tuple(r) for r in cover_tree.near_duplicates(df).collect()], key=str)
    assert got == brute(data)[0]


def test_empty_table(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_net_and_tree_cover():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    up = cover_tree.tree(x)
    for radius, ancestors in zip(cover_tree.RADII, up, strict=True):
        centres = np.unique(ancestors)
        gap = np.sqrt(np.maximum(0, 2 - 2 * x[centres] @ x[centres].T)) + 9 * np.eye(len(centres))
        assert gap.min() >= radius - 1e-9
    assert (up[1] == up[1][up[0]]).all()


@pytest.mark.parametrize("spread", [0.0005, 0.3])
def test_large_blocks_are_divided(spark, monkeypatch, spread):
    """Blocks around few pivots are divided further, by pivots or, where these don't help, by hash."""
    monkeypatch.setattr(cover_tree, "BLOCK", 8)
    monkeypatch.setattr(cover_tree, "MOST", 4)
    rng = np.random.default_rng(4)
    data = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(np.concatenate((rng.normal(size=(1, 4)) + rng.normal(size=(150, 4)) * spread, rng.normal(size=(80, 4)))))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted([tuple(r) for r in cover_tree.near_duplicates(df).collect()], key=str) == brute(data)[0]


def test_bounds_spare_products():
    """Of 200 tight clusters little more is multiplied than pairs of near nodes; evenly spread points cost one matrix."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(200, 64))
    x = np.repeat(base, 15, axis=0) + rng.normal(size=(3000, 64)) * 0.05
    x = rng.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    every, told = np.arange(len(x)), [0]
    count, _ = cover_tree.traverse(x, every, every, cover_tree.tree(x), np.ones(len(x), int), 0.95, told)
    s = x @ x.T
    want = (s >= 0.95).sum(1) - 1
    assert (count == want).all() and want.sum() > 20_000
    assert told[0] < 0.03 * len(x) ** 2
    z = rng.normal(size=(900, 64))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    told = [0]
    cover_tree.traverse(z, every[:900], every[:900], cover_tree.tree(z), np.ones(900, int), 0.95, told)
    assert told[0] <= 1.5 * 900**2


def test_lengths_do_not_matter(spark, monkeypatch):
    """v and 2 v in blocks that are divided, and an empty first block pair."""
    monkeypatch.setattr(cover_tree, "BLOCK", 6)
    rng = np.random.default_rng(2)
    rows = [v.tolist() for v in rng.normal(size=(40, 3))]
    rows += [[2 * c for c in v] for v in rows] + [rows[0]] * 9
    data = list(enumerate(rows))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert sorted([tuple(r) for r in cover_tree.near_duplicates(df).collect()], key=str) == brute(data)[0]
