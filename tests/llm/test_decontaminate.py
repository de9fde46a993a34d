from __future__ import annotations

import random
import re

import pytest

from matchlake.llm import decontaminate


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w = words(text)
        hit, listed = set(), set()
        for item, it in items:
            q = words(it)
            k = min(window, len(q))
            for i in range(len(q) - k + 1 if q else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == q[i : i + k]:
                        hit.update(range(p, p + k))
                        if item is not None:
                            listed.add(str(item))
        out.append((doc, len(w), len(hit), sorted(listed)))
    return out


def test_scan_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["A", "b", "c-d", "é1", "7"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, make(rng.choice([0, 3, 12, 40, 200]))) for i in range(60)] + [(100, None), (101, ""), (None, make(30)), (5, make(50))]
    items = [(i, make(rng.choice([0, 2, 4, 10, 14, 30]))) for i in range(12)] + [(50, None), (None, docs[3][1]), (10, docs[2][1])]
    docs.append((7, "x y " + docs[3][1] + " z"))
    docs.append((7, "x y " + docs[3][1] + " z"))
    monkeypatch.setattr(decontaminate, "SHARD", 300)
    monkeypatch.setattr(decontaminate, "BLOCK", 40)
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(df, bench).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], str(r[3]))
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted(brute(docs, items), key=key)
    unlisted = decontaminate.scan(df, bench, listed=False)
    assert "matches" not in unlisted.columns and sorted([tuple(r) for r in unlisted.collect()], key=key) == sorted(brute(docs, items), key=key)
    for r in got:
        for m in r["matches"]:
            assert m["doc_at"] + m["n_words"] <= r["n_words"]
    clean = {tuple(r)[:2] for r in decontaminate.remove(df, bench).collect()}
    assert clean == {d for d, b in zip(docs, brute(docs, items), strict=True) if b[2] == 0}


def test_longest_match_and_place(spark):
    item = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, "a b " + " ".join(f"w{i}" for i in range(5, 22)) + " c")], "doc_id long, text string")
    (row,) = decontaminate.scan(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [tuple(m) for m in row["matches"]] == [("9", 5, 2, 17)]


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty_tables(spark, empty):
    df = spark.createDataFrame([(1, "a b c")] if empty == "items" else [], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "a b c")] if empty == "docs" else [], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate.scan(df, bench).collect()] == ([0] if empty == "items" else [])


def test_long_windows_and_short_items(spark, monkeypatch):
    """Suffixes are ordered as deep as the longest window; occurrences of one-word items are looked at in parts."""
    monkeypatch.setattr(decontaminate, "LISTED", 7)
    head = " ".join(f"h{i}" for i in range(16))
    docs = [(i, f"{head} " + " ".join(f"t{i}x{j}" for j in range(14))) for i in range(40)] + [(99, "the cat the cat " * 30)]
    items = [(i, t) for i, t in docs[:40]] + [(77, "The"), (78, "CAT the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = sorted((tuple(r) for r in decontaminate.scan(df, bench, 24, listed=False).collect()), key=str)
    assert got == sorted(brute(docs, items, 24), key=str)
    assert {r[0] for r in decontaminate.remove(df, bench, 24).collect()} == set()


def test_benchmark_of_many_blocks(spark, monkeypatch):
    """Blocks take turns, and their findings add up."""
    rng = random.Random(6)
    make = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    items = [(i, make(25)) for i in range(60)]
    docs = [(k, make(20) + " " + items[k][1][:90] + " " + items[59 - k][1] + " " + make(9)) for k in range(12)] + [(50, make(80))]
    monkeypatch.setattr(decontaminate, "BLOCK", 400)
    held = []
    monkeypatch.setattr(decontaminate, "saved", lambda df, real=decontaminate.saved: held.append(1) or real(df))
    got = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(brute(docs, items)) and len(held) > 2


def test_equal_items_are_searched_once():
    """A thousand equal items give the pairs of one, and two items in part alike those of their different windows."""
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    text = f"a b {passage} c {passage} d"
    words_, at = decontaminate.ALNUM.hashes(*decontaminate.flat(decontaminate.pa.array([text] * 3)))
    array = decontaminate.SuffixArray(words_, at)
    pairs = lambda texts: sum(len(d) for _, d in array.matches(decontaminate.Items([str(k) for k in range(len(texts))], texts, 10).distinct()))
    assert pairs([passage]) == pairs([passage] * 1000) == 3 * 2 * 31
    assert pairs([passage, passage + " other words"]) == 3 * 2 * 31
    windows = decontaminate.Items(["x", "y", None], [passage, passage, passage], 10).distinct()
    assert windows.lists == [["x", "y"]]
    hit, found, _ = decontaminate._covered(words_, at, windows)
    assert hit.sum() == 3 * 80 and found == [{"x", "y"}] * 3
