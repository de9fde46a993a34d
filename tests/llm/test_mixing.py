from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from matchlake.llm import mixing
from matchlake.llm.sql import SQL


def goals(sizes, weights=(5, 2, 1), most=3):
    """Sizes by source in order: targets by sharing the excess again and again."""
    out, left = {}, float(sum(sizes))
    free = set(range(len(sizes)))
    while free:
        shares = sum(weights[k % len(weights)] for k in free)
        over = {k for k in free if left * weights[k % len(weights)] / shares > most * sizes[k]}
        for k in over or free:
            out[k] = float(most * sizes[k]) if over else left * weights[k % len(weights)] / shares
        left -= sum(out[k] for k in over)
        free -= over or free
    return [out[k] for k in range(len(sizes))]


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, place int, rank int, block int")


def example(seed, n=400):
    rng = random.Random(seed)
    names = ["b", "a", "A", "", None, "é", "zz"]
    rows = []
    for k in range(n):
        words = rng.choice([0, 1, 3, 10, 40, 200])
        text = rng.choice([None, "", " \t\n"]) if not words else rng.choice([" ", "\n\n", "\x0b"]).join(f"w{rng.randrange(9)}" for _ in range(words))
        source = "zz" if rng.random() < 0.4 else rng.choice(names[: 1 + seed % 7])
        rows.append((k if rng.random() < 0.95 else None, text, source, "x", 1, 2, 3))
    return rows + rows[:20]


@pytest.mark.parametrize(("seed", "block"), [(1, 50), (6, 200)])
def test_amounts(spark, seed, block):
    rows = example(seed)
    got = mixing.amounts(made(spark, rows).repartition(3), block=block, shard=4).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for r in rows:
        total[r[2]] += size(r[1])
    order = sorted(total, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, goals([total[s] for s in order]), strict=True))
    of = {r[0]: r for r in rows}
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    taken = Counter()
    for r in got:
        if r["doc_id"] is not None:
            source = of[r["doc_id"]][2]
            assert r["source_size"] == total[source] and abs(r["target"] - target[source]) < 1e-6
            assert r["size"] == 0 == r["taken"] or r["taken"] % r["size"] == 0
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    for s in order:
        assert abs(taken[round(target[s], 6), total[s]] - target[s]) <= 200 or total[s] == 0
    again = mixing.amounts(made(spark, rows).repartition(7), block=block, shard=4).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_equals_sql(spark):
    rows = example(6, 300)
    got = mixing.amounts(made(spark, rows)).select("doc_id", "size", "source_size", F.round("target", 6), "taken").collect()
    duck = duckdb.connect()
    duck.execute("create table documents(doc_id bigint, text varchar, source varchar)")
    duck.executemany("insert into documents values (?, ?, ?)", [r[:3] for r in rows])
    assert Counter(map(tuple, got)) == Counter((a, b, c, round(d, 6), e) for a, b, c, d, e in duck.execute(SQL["op11_mixing"]).fetchall())


def test_empty_and_wordless(spark):
    assert mixing.amounts(made(spark, [])).collect() == []
    assert mixing.mixed(made(spark, [])).collect() == []
    got = mixing.amounts(made(spark, [(1, None, "a", None, 1, 1, 1), (2, " ", None, None, 1, 1, 1)])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_hypergeometric(spark):
    """At evenly spaced chances every outcome comes as often as its probability says."""
    grid, cases = 3000, [(20, 7, 9), (50, 49, 25), (9, 0, 4), (9, 9, 4), (1000, 300, 500), (7, 3, 0), (7, 3, 7)]
    of = spark.createDataFrame(cases, "n long, k long, d long").crossJoin(spark.range(grid))
    got = Counter(map(tuple, of.select("n", "k", "d", mixing.hypergeometric(F.col("n"), F.col("k"), F.col("d"), (F.col("id") + 0.5) / grid)).collect()))
    for n, k, d in cases:
        for x in range(d + 1):
            p = math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d) if x <= k and d - x <= n - k else 0
            assert abs(got[n, k, d, x] - grid * p) <= 1.01


@pytest.mark.parametrize(("bits", "sources", "shards"), [(8, 5, 4), (1, 6, 5)])
def test_split(spark, monkeypatch, bits, sources, shards):
    """Shards are of equal size and all draws are dealt, with groups of sources too."""
    monkeypatch.setattr(mixing, "GROUP_BITS", bits)
    quota = {k: (k * 37 + 5) % 60 for k in range(sources)}
    total = sum(quota.values())
    got = mixing.split(spark.createDataFrame(list(quota.items()), "rank long, quota long"), shards, total, sources, 3).collect()
    by_shard, by_rank = Counter(), Counter()
    for s, r, n in got:
        assert n > 0
        by_shard[s] += n
        by_rank[r] += n
    assert by_rank == Counter({k: v for k, v in quota.items() if v})
    assert [by_shard[s] for s in range(shards)] == [(s + 1) * total // shards - s * total // shards for s in range(shards)]


def test_mixed_takes_what_amounts_say(spark):
    rows = [r for r in example(6) if r[0] is not None][:380]
    docs = made(spark, rows)
    said = {r["doc_id"]: (r["taken"] // r["size"] if r["size"] else 0) for r in mixing.amounts(docs, block=50, shard=4).collect()}
    copies = Counter(r[0] for r in rows)
    out = mixing.mixed(docs, block=50, shard=4)
    assert out.columns == [*docs.columns, "shard"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: said[k] * copies[k] for k in copies if said[k]})
    with pytest.raises(ValueError):
        mixing.mixed(docs, shard_name="Text")


def test_draws_are_disjoint(spark):
    _, goals_, drawn = mixing.draws(made(spark, example(13)), block=20, shard=4)
    got = Counter((r["rank"], r["block"], r["pass"]) for r in drawn.collect())
    want = {(g["rank"], b % g["blocks"], b // g["blocks"]) for g in goals_.collect() for b in range(g["quota"])}
    assert set(got) == want and set(got.values()) == {1}
