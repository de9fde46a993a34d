from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from matchlake.llm import quality, toxicity
from matchlake.llm.kernels import flat


def maximal(score):
    """All maximal scoring segments by definition: the best one, then those on either side of it."""
    if not len(score):
        return []
    best, at = 0.0, None
    for i in range(len(score)):
        for j in range(i + 1, len(score) + 1):
            s = score[i:j].sum()
            if s > best + 1e-9:
                best, at = s, (i, j)
    if at is None:
        return []
    left = maximal(score[: at[0]])
    right = [(a + at[1], b + at[1], s) for a, b, s in maximal(score[at[1] :])]
    return [*left, (*at, best), *right]


def test_segments_equal_their_definition():
    rng = np.random.default_rng(2)
    for _ in range(60):
        s = rng.normal(size=rng.integers(0, 25)) + 0.013
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == [(a, b) for a, b, _ in maximal(s)]


def corpus(n, seed):
    rng = random.Random(seed)
    plain, bad = [f"w{i}" for i in range(400)], ["idiot", "scum", "moron"]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        poor = i % 5 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if poor else " ".join(w) + ".", int(toxic), int(not poor)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "k") for i, t, _, _ in rows], "doc_id long, text string, toxic_score string")
    labels = spark.createDataFrame([(i, x, q) for i, _, x, q in rows if i % 7 != 3], "doc_id long, toxic int, quality int")
    return docs, labels


def test_toxicity_finds_held_out_texts_and_passages(spark):
    rows = corpus(900, 1) + [(9000, "", 0, 1), (9001, None, 0, 1), (9002, "§ - §", 0, 1)]
    docs, labels = tables(spark, rows)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model, ["doc_id"], passages=True).collect()}
    test = [r for r in rows if r[0] % 5 == 0]
    assert np.mean([(got[i]["toxic_score"] >= 0.5) == bool(x) for i, _, x, _ in test]) > 0.97
    assert got[9001]["toxic_score"] == got[9000]["toxic_score"] < 0.5 and got[9000]["passages"] == []
    toxic = next(i for i, _, x, _ in rows if x)
    words = next(t for i, t, _, _ in rows if i == toxic).lower().split()
    assert any(w.strip("!.") in ("idiot", "scum", "moron") for p in got[toxic]["passages"] for w in words[p["begin"] : p["end"]])


def test_quality_learns_shapes(spark):
    rows = corpus(700, 2) + [(9000, "", 0, 1), (9001, None, 0, 1)]
    docs, labels = tables(spark, rows)
    model = quality.fit(docs, labels, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model, ["doc_id"]).collect()}
    test = [r for r in rows if r[0] % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == bool(q) for i, _, _, q in test]) > 0.97
    assert got[9000] == got[9001] and all(0 <= v <= 1 for v in got.values())


def test_models_without_both_labels(spark):
    rows = corpus(30, 3)
    docs, labels = tables(spark, rows)
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        one = labels.withColumn(label, F.lit(1))
        model = module.fit(docs, one, F.lit(True))
        assert {r[1] for r in module.score(docs, model, ["doc_id"]).collect()} == {1.0}
        none = module.fit(docs, labels.where("false"), F.lit(True))
        assert {r[1] for r in module.score(docs, none, ["doc_id"]).collect()} == {0.0}
        assert module.score(docs.where("false"), none, ["doc_id"]).count() == 0


def test_hinge_fit_separates():
    rng = np.random.default_rng(0)
    xs = [(np.sort(rng.choice(40, 6, replace=False)), np.ones(6)) for _ in range(200)]
    w = rng.normal(size=40)
    y = np.array([1.0 if w[f].sum() > 0 else -1.0 for f, _ in xs])
    fitted, bias = quality.descend(xs, y, cost=50.0, epochs=400)
    assert np.mean([np.sign(fitted[f] @ v + bias) == k for (f, v), k in zip(xs, y, strict=True)]) > 0.97


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    from matchlake.llm import queries

    docs = [(i, f"word{i % 7} plain text {'idiot scum' if i % 3 == 0 else 'nice day'}") for i in range(60)] + [(None, "plain text idiot"), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (queries.op4_toxicity, queries.op9_quality):
        rows = query(spark, str(tmp_path)).collect()
        assert len(rows) == 62 and all(r["held_out"] is False for r in rows if r["doc_id"] is None)
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows) and 0 < sum(r["held_out"] for r in rows) < 60


def by_hand(rows):
    """Scores by counts, ratios, dual coordinate descent and a logistic curve over dicts, of (id, text, label or None)."""
    feats = {i: [int(f) for f in quality.features(*flat(pa.array([t])))[0]] for i, t, _ in rows}
    marked = sorted((i, y) for i, _, y in rows if y is not None)
    counts = [Counter(f for i, v in marked if v == k for f in feats[i]) for k in (0, 1)]
    total = [quality.SMOOTH * quality.BUCKETS + sum(c.values()) for c in counts]
    ratio = lambda f, own=(0, 0): math.log((quality.SMOOTH + counts[1][f] - own[1]) / total[1]) - math.log((quality.SMOOTH + counts[0][f] - own[0]) / total[0])

    def scaled(values):
        length = max(1e-12, math.sqrt(sum(v * v for v in values.values())))
        return {f: v / length for f, v in values.items()}

    xs = [scaled({f: ratio(f, (1 - y, y)) for f in feats[i]}) for i, y in marked]
    ys = [2 * y - 1 for _, y in marked]
    fitting, test = [k for k in range(len(xs)) if k % 5], [k for k in range(len(xs)) if k % 5 == 0]
    w, bias, alpha, rng = Counter(), 0.0, [0.0] * len(fitting), np.random.default_rng(1)
    for _ in range(quality.EPOCHS):
        worst = 0.0
        for n in rng.permutation(len(fitting)):
            x, y = xs[fitting[n]], ys[fitting[n]]
            g = y * (sum(w[f] * v for f, v in x.items()) + bias) - 1
            new = min(max(alpha[n] - g / (sum(v * v for v in x.values()) + 1), 0.0), quality.COST)
            step, worst = (new - alpha[n]) * y, max(worst, abs(new - alpha[n]))
            alpha[n] = new
            bias += step
            for f, v in x.items():
                w[f] += step * v
        if worst < 1e-3:
            break
    z = [sum(w[f] * v for f, v in xs[k].items()) + bias for k in test]
    slope, offset = quality.logistic(np.array(z), np.array([ys[k] > 0 for k in test], float))
    margin = {i: sum(w[f] * v for f, v in scaled({f: ratio(f) for f in feats[i]}).items()) + bias for i in feats}
    return {i: 1 / (1 + math.exp(-slope * m - offset)) for i, m in margin.items()}


def test_quality_equals_a_plain_version(spark):
    """Long, empty and repeated texts among them."""
    rows = [(i, t, q if i % 7 != 3 and i % 4 != 2 else None) for i, t, _, q in corpus(160, 5)]
    rows += [(900, "", None), (901, rows[0][1], rows[0][2]), (902, rows[0][1], None), (903, "Some words. " * 30_000, None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, quality int")
    got = {r[0]: r[1] for r in quality.score(docs, quality.fit(docs, labels, F.lit(True)), ["doc_id"]).collect()}
    want = by_hand(rows)
    assert got.keys() == want.keys() and max(abs(got[i] - v) for i, v in want.items()) < 1e-6
    assert got[902] == got[0] and min(got.values()) < 0.1 < 0.9 < max(got.values())


def test_toxicity_equals_a_plain_version(spark):
    """Counts, left-out segments by definition, calibration and scores, of repeated, empty and one-word texts too."""
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(140):
        words = [rng.choice(pool) for _ in range(rng.randint(1, 22))]
        if i % 4 == 0:
            words[rng.randrange(len(words)) :] = [rng.choice(["idiot", "scum"]) for _ in range(3)]
        rows.append((i, " ".join(words), int(i % 4 == 0) if i % 5 else None))
    rows += [(900, "", 0), (901, rows[4][1], None), (902, rows[4][1], rows[4][2]), (903, "scum", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    got = {r[0]: r[1] for r in toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True)), ["doc_id"]).collect()}
    parts = {i: [x.tolist() for x in toxicity.tokens(*flat(pa.array([t])))[:2]] for i, t, _ in rows}
    tables = [Counter(x for i, _, y in rows if y == k for side in parts[i] for x in side) for k in (0, 1)]
    sums = [max(1, sum(len(parts[i][0]) for i, _, y in rows if y == k)) for k in (0, 1)]
    share = sums[1] / (sums[0] + sums[1])

    def found(i, leave=None):
        own = [Counter(x for side in parts[i] for x in side) if leave == k else Counter() for k in (0, 1)]
        count = lambda k, x: tables[k][x] - own[k][x]
        odds = []
        for token, start in zip(*parts[i], strict=True):
            p = (count(1, start) + toxicity.BETA * share) / (count(1, start) + count(0, start) + toxicity.BETA)
            odds.append(math.log((count(1, token) + toxicity.ALPHA * p) / sums[1]) - math.log((count(0, token) + toxicity.ALPHA * (1 - p)) / sums[0]) - toxicity.DRIFT)
        return [s for _, _, s in maximal(np.array(odds))]

    seen = pd.DataFrame([(y, len(parts[i][0]), found(i, y)) for i, _, y in rows if y is not None], columns=["label", "n", "sums"])
    law = toxicity.Model(np.ones(toxicity.TOKENS + toxicity.STARTS), np.ones(toxicity.TOKENS + toxicity.STARTS), (1, 1))
    toxicity.calibrate(law, seen)
    for i, value in got.items():
        bar = law.location + math.log(max(1, len(parts[i][0]))) / law.decay
        evidence = math.log1p(sum((s - bar) * law.decay for s in found(i) if s > bar))
        assert abs(value - 1 / (1 + math.exp(-law.slope * evidence - law.offset))) < 1e-6, i
    assert got[901] == got[902] == got[4] and min(got.values()) < 0.4 < 0.6 < max(got.values())
