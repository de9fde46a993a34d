from __future__ import annotations

import random
import re

import pytest

from matchlake.llm import ngram_join
from matchlake.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and docs[i][0] is not None and docs[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))], key=str)


def corpus(seed, near=40):
    rng = random.Random(seed)
    make = lambda n: [rng.choice("abcdefghij") + str(rng.randint(0, 60)) for _ in range(n)]
    line = make(9)
    docs = [make(rng.choice([0, 1, 3, 5, 8, 40, 120])) for _ in range(40)]
    for _ in range(4):
        base = make(rng.choice([30, 60, 200]))
        for _ in range(near // 4):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randint(0, 9))
            docs.append(copy[rng.randint(0, 3) :] + make(rng.randint(0, 3)))
    docs += [make(20) + line + make(20) for _ in range(15)] + [line] * 3
    rows = [(i, rng.choice([" ", "\n"]).join(w).upper() if i % 7 == 0 else " ".join(w)) for i, w in enumerate(docs)]
    rng.shuffle(rows)
    return [*rows, (900, None), (901, ""), (None, rows[0][1]), (rows[3][0], rows[3][1])]


@pytest.mark.parametrize(("small", "block", "group", "near"), [(64, 2048, 1 << 20, 40), (3, 2048, 300, 40), (2, 8, 100, 60), (2, 5, 1 << 20, 100)])
def test_equals_brute_force(spark, monkeypatch, small, block, group, near):
    for name, value in (("SMALL", small), ("LEAF", small), ("BLOCK", block), ("GROUP", group), ("SPLIT", 3 if small < 64 else 512), ("PIVOTS", 2 if small < 64 else 8), ("FIRST", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    docs = corpus(small * 7 + block, near)
    df = spark.createDataFrame([(a, b, 0.5) for a, b in docs], "doc_id long, text string, n double").repartition(3)
    assert sorted([tuple(r) for r in ngram_join.join(df).collect()], key=str) == brute(docs)


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(70)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if sum(1 for v in root.values() if v == r) > 1}
