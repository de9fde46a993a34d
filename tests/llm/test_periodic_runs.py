from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from matchlake.llm import periodic_runs, queries


def brute(words, least=6, repeats=4):
    """All maximal stretches with a period, kept where no smaller one has it."""
    n, best = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda x: (x[0], x[2]))


def sample(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(90))]
    if kind == 1:
        root = [rng.randrange(5) for _ in range(rng.randrange(1, 25))]
        return [rng.randrange(5) for _ in range(rng.randrange(9))] + root * rng.randrange(1, 8) + root[: rng.randrange(len(root) + 1)] + [rng.randrange(5) for _ in range(rng.randrange(9))]
    a, b = [0], [0, 1]
    for _ in range(rng.randrange(7)):
        a, b = b, b + a
    return b * rng.randrange(1, 6) if kind == 2 else sum(([rng.randrange(2)] * rng.randrange(1, 9) for _ in range(12)), []) * rng.randrange(1, 5)


@pytest.mark.parametrize(("least", "repeats"), [(6, 4), (2, 2), (1, 3)])
def test_runs_equal_brute_force(least, repeats):
    rng = random.Random(repeats)
    for _ in range(500):
        w = sample(rng)
        assert periodic_runs.runs_of(w, least, repeats) == brute(w, least, repeats), w


def test_a_lying_hash_makes_no_false_run(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_PRIME", 3)
    rng = random.Random(5)
    for _ in range(200):
        w = sample(rng)
        assert set(periodic_runs.runs_of(w)) <= set(brute(w))


def test_very_long_texts():
    w = [0] * 30_000 + [k % 700 for k in range(40_000)]
    assert periodic_runs.runs_of(w) == [(0, 30_001, 1), (30_000, 40_000, 700)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def digest(text):
    w = words_of(text)
    runs = brute(w)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def texts():
    rng = random.Random(9)
    out = [None, "", " \n", "ha " * 5, "ha " * 6, "a b\x0ba\tb\x0ca\rb a b c", " x " * 7, "x y " * 9, "é　 " * 8]
    for k in range(60):
        prose = [f"w{rng.randrange(200)}" for _ in range(rng.randrange(80))]
        part = [f"p{rng.randrange(6)}" for _ in range(rng.randrange(1, 9))] * rng.randrange(2, 9)
        out.append(rng.choice([" ", "\n", " \t"]).join(prose + part + prose[:9] * (k % 6)))
    return out + out[20:24]


def test_digests_runs_and_collapse(spark):
    data = [(k if k % 9 else None, t, 1, "x") for k, t in enumerate(texts())]
    df = spark.createDataFrame(data, "doc_id long, text string, start int, words string").repartition(3)
    got = periodic_runs.digests(df).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((k, *digest(t))) for k, t, *_ in data)
    runs = sorted(str(tuple(r)) for r in periodic_runs.runs(df).collect())
    assert runs == sorted(str((k, *r)) for k, t, *_ in data for r in brute(words_of(t)))
    cut = periodic_runs.collapse(df)
    assert cut.columns == df.columns
    for r in cut.collect():
        source = next(t for k, t, *_ in data if k == r["doc_id"]) if r["doc_id"] is not None else None
        if source is not None:
            gone = {k for s, m, q in brute(words_of(source)) for k in range(s + q, s + m)}
            assert r["text"] == (" ".join(x for k, x in enumerate(words_of(source)) if k not in gone) if gone else source)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.digests(empty).collect() == periodic_runs.runs(empty).collect() == []


def test_query(spark, tmp_path):
    """Texts whose doc_id's checksum says so are made periodic from a word on."""
    data = [(k if k % 50 else None, t) for k, t in enumerate(texts() * 3)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, changed = [], 0
    for k, t in data:
        w = words_of(t)
        h = zlib.crc32(str(k).encode()) if k is not None else 1
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
            changed += 1
        want.append(str((k, *digest(t))))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert changed > 5 and sorted(str(tuple(r)) for r in got) == sorted(want)
