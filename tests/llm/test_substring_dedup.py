from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from matchlake.llm import substring_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(docs, window):
    count = Counter(tuple(w[i : i + window]) for _, t in docs for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for doc, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "group"), [(35, 1 << 20), (6, 50), (4, 200), (1, 70), (2, 90)])
def test_equals_brute_force(spark, monkeypatch, window, group):
    rng = random.Random(window)
    letters = [f"w{i}" for i in range(4 if window < 9 else 60)] + ["É x", "A", "a"]
    make = lambda n: rng.choice([" ", "\n", "\t "]).join(rng.choice(letters) for _ in range(n))
    passage = [make(rng.randint(window, 3 * window)) for _ in range(5)]
    docs = [(i, make(rng.choice([0, 1, window, 3 * window, 90]))) for i in range(60)]
    docs += [(i, make(20) + " " + rng.choice(passage) + " " + make(20)) for i in range(60, 100)]
    docs += [(200, None), (201, ""), (None, make(80)), (5, docs[80][1]), docs[81], docs[81], (300, " ".join(passage * 4))]
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    df = spark.createDataFrame([(a, b, "k") for a, b in docs], "doc_id long, text string, key string").repartition(3)
    got = sorted([tuple(r) for r in substring_dedup.digests(df, window).collect()], key=str)
    assert got == brute(docs, window)
    back = substring_dedup.remove_repeats(df, window).collect()
    assert len(back) == len(docs) and back[0].__fields__ == ["doc_id", "text", "key"]
    want = Counter((d, h) for d, _, _, h in brute(docs, window))
    assert Counter((r[0], hashlib.sha256(" ".join(words(r[1])).encode()).hexdigest()) for r in back) == want


def test_empty_table(spark):
    assert substring_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_copies_and_null_ids(spark):
    """Copies of a row cost no more than a row each: only one stands in the graph."""
    rng = random.Random(3)
    make = lambda n: " ".join(f"w{rng.randint(0, 99999)}" for _ in range(n))
    text, other = make(300), make(90)
    docs = [(None, text)] * 500 + [(7, text)] * 200 + [(8, other + " " + " ".join(text.split()[40:120])), (None, make(50)), (None, make(50))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted([tuple(r) for r in substring_dedup.digests(df, 35).collect()], key=str) == brute(docs, 35)


def test_chains_follow_degrees():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(2, 9))
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (int(rng.integers(1, 14)), 2))})
        here = rng.random(n) < 0.8
        u, v = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
        head, after = substring_dedup.chains(u, v, here[u.astype(int)], here[v.astype(int)])
        ins, outs = Counter(b for _, b in pairs), Counter(a for a, _ in pairs)
        passing = {x for x in range(n) if here[x] and ins[x] == outs[x] == 1}
        following = {k: next(j for j, q in enumerate(pairs) if q[0] == p[1]) for k, p in enumerate(pairs) if p[1] in passing}
        group = list(range(len(pairs)))  # brute force: classes of edges that passing nodes join
        for _ in pairs:
            for k, j in following.items():
                group[k] = group[j] = min(group[k], group[j])
        assert len(set(zip(group, head.tolist(), strict=True))) == len(set(group)) == len(set(head.tolist()))
        for k in range(len(pairs)):
            if after[k] >= 0:
                assert following[k] == after[k]
            elif k in following:  # a cycle is opened once, before its head
                assert following[k] == head[k]


def test_spans_join_paths_of_several_buckets(spark):
    rng = random.Random(9)
    make = lambda n: " ".join(f"w{rng.randint(0, 99999)}" for _ in range(n))
    passage = make(400)
    docs = [(k, make(30 + k) + " " + passage + " " + make(20)) for k in range(3)] + [(9, make(80))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4, "doc_id")
    got = [tuple(r) for r in substring_dedup.spans(df, 35).collect()]
    assert sorted((d, at, n) for d, _, at, n in got) == [(k, 30 + k, 400) for k in range(3)]
    assert len({p for _, p, _, _ in got if p is not None}) <= 1
