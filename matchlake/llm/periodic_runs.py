"""Periodic runs of words by Lyndon factors, and their collapse to one period.

A run is a maximal stretch with smallest period q of at least max(least,
repeats * q) words.  Right-to-left scans with a stack find the longest Lyndon
word at every place, once under an order of the words and once under its
reverse; every run has a Lyndon root under one of the two, so it is found by
extending the roots to both sides.  Suffixes are compared, and roots extended,
by the longest common extension: a few words directly, then a binary search on
rolling hashes.  Every run is verified word by word before it counts; there is
no suffix array.

Each word of a run occurs in it `repeats` times at least.  So stretches are
first cut, again and again, at words that occur less often in their stretch:
no run is lost, as it lies inside one stretch, and ordinary prose is not
scanned at all.

One pass over the documents, without a shuffle.  Memory: some ten numbers for
each word of a batch's few megabytes or of the longest text.

Defined cases: null texts and texts without words have no runs; rows are
judged by themselves, repeated or not; an empty table gives an empty result;
only the key and text columns are read (`collapse` hands on all columns).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from matchlake.llm.kernels import PLAIN, flat, mix, slices, tidy

LEAST, REPEATS = 6, 4
#: Cuts of stretches at most; a stretch that could be cut further is only scanned at greater length.
_CUTS = 12
_PRIME, _BASE = (1 << 61) - 1, 0x1F3B5D7A9C2E4681
#: Words compared one by one before hashes are used.
_NEAR = 12


def stretches(h: np.ndarray, offsets: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """Ranges of words, none across documents, that hold all runs: words that occur too seldom in their stretch cut it."""
    at = np.arange(len(h))
    group = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for _ in range(_CUTS):
        if not len(at):
            break
        _, of, count = np.unique(mix(h[at] + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        stays = count[of] >= repeats
        if stays.all():
            break
        at, group = at[stays], group[stays]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        long = np.bincount(group, minlength=1)[group] >= least if len(at) else new
        at, group = at[long], group[long]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (group[1:] != group[:-1])))) if len(at) else np.zeros(0, int)
    ends = np.concatenate((first[1:], [len(at)])) if len(first) else first
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(first, ends, strict=True)]


class Extensions:
    """Longest common extensions of places of a sequence of numbers, to the right and to the left."""

    def __init__(self, words: list[int]):
        self.words = words
        self.sums: list[int] = []
        self.powers: list[int] = []

    def _same(self, i: int, j: int, n: int) -> bool:
        """Whether n words from i and from j > i are alike, by their rolling hashes."""
        if not self.sums:
            self.powers = list(accumulate(repeat(_BASE, len(self.words)), lambda a, b: a * b % _PRIME, initial=1))
            self.sums = list(accumulate(((w + 1) * p for w, p in zip(self.words, self.powers)), lambda a, b: (a + b) % _PRIME, initial=0))
        s = self.sums
        return ((s[i + n] - s[i]) * self.powers[j - i] - s[j + n] + s[j]) % _PRIME == 0

    def right(self, i: int, j: int) -> int:
        """How many words from i and from j > i on are alike."""
        w, most = self.words, len(self.words) - j
        near = min(_NEAR, most)
        k = 0
        while k < near and w[i + k] == w[j + k]:
            k += 1
        return k if k < near or k == most else self._most(most, k, lambda n: self._same(i, j, n))

    def left(self, i: int, j: int) -> int:
        """How many words before i and before j > i are alike."""
        w = self.words
        near = min(_NEAR, i)
        k = 0
        while k < near and w[i - 1 - k] == w[j - 1 - k]:
            k += 1
        return k if k < near or k == i else self._most(i, k, lambda n: self._same(i - n, j - n, n))

    @staticmethod
    def _most(top: int, known: int, same) -> int:
        """The largest n from known to top for which same(n); steps double, then halve."""
        step = known
        while known < top and same(min(known + step, top)):
            known = min(known + step, top)
            step *= 2
        high = min(known + step, top)
        return known if known == top else known + bisect_right(range(known + 1, high), False, key=lambda n: not same(n))


def lyndon_ends(words: list[int], extend: Extensions, up: bool) -> list[int]:
    """For each place the end of the longest Lyndon word there, under the numbers' order or its reverse; what ends first is smaller."""
    n = len(words)
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        j, x = i + 1, words[i]
        while j < n:
            y = words[j]
            if x == y:
                k = extend.right(i, j)
                if j + k == n or (words[i + k] < words[j + k]) != up:
                    break
            elif (x < y) != up:
                break
            j = ends[j]
        ends[i] = j
    return ends


def _primitive(root: list[int]) -> bool:
    """Whether root is not a shorter stretch repeated (a Lyndon word never is, unless a hash lied)."""
    n = len(root)
    return not any(n % d == 0 and root[d:] == root[: n - d] for d in range(1, n // 2 + 1) if root[d] == root[0])


def runs_of(words: list[int], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n, found = len(words), set()
    if n < max(least, repeats):
        return []
    extend, numbers, places = Extensions(words), np.array(words), np.arange(n)
    for up in (True, False):
        period = np.array(lyndon_ends(words, extend, up)) - places
        # a root in a run's first period has repeats - 1 whole periods behind it
        some = np.flatnonzero(places + (repeats - 1) * period <= n)
        p = period[some]
        alike = numbers[some] == numbers[np.minimum(some + p, n - 1)]
        if repeats > 2:
            last = some + (repeats - 2) * p - 1
            alike &= numbers[last] == numbers[last + p]
        else:
            alike[:] = True
        known: dict[int, tuple[int, int]] = {}
        for i, q in zip(some[alike].tolist(), p[alike].tolist(), strict=True):
            start, stop = known.get(q, (0, 0))
            if start <= i and i + q < stop or i + q > n:
                continue
            r = extend.right(i, i + q) if i + q < n else 0
            if r < (repeats - 2) * q:
                continue
            a, b = i - extend.left(i, i + q), i + q + r
            if words[a : b - q] != words[a + q : b]:  # a hash lied: extend word by word
                a, b = i, i + q
                while a and words[a - 1] == words[a - 1 + q]:
                    a -= 1
                while b < n and words[b - q] == words[b]:
                    b += 1
            known[q] = (a, b)
            if b - a >= max(least, repeats * q) and _primitive(words[a : a + q]):
                found.add((a, b - a, q))
    return sorted(found, key=lambda x: (x[0], x[2]))


def _numbers(words) -> list[int]:
    """Equal words as equal numbers."""
    of: dict = {}
    return [of.setdefault(w, len(of)) for w in words]


def runs_by_text(column: pa.Array, least: int = LEAST, repeats: int = REPEATS) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs."""
    data, at = flat(column)
    for lo, hi in slices(at):
        h, offsets = PLAIN.hashes(data, at[lo : hi + 1])
        some: dict[int, list[tuple[int, int]]] = {}
        for a, b in stretches(h, offsets, least, repeats):
            some.setdefault(int(np.searchsorted(offsets, a, "right")) - 1, []).append((a, b))
        for k in range(hi - lo):
            words, found = bytes(data[at[lo + k] : at[lo + k + 1]]).split(), []
            for a, b in some.get(k, ()):
                begin = a - int(offsets[k])
                part = words[begin : begin + b - a]
                found += [(begin + s, n, q) for s, n, q in runs_of(_numbers(part), least, repeats)]
            yield words, found


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    out = np.zeros(n, bool)
    for s, size, q in runs:
        out[s + q : s + size] = True
    return out


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    return [words[k] for k in np.flatnonzero(~dropped(len(words), runs)).tolist()] if runs else words


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or (d := r[1] * best[2] - best[1] * r[2]) > 0 or d == 0 and (r[0], r[2]) < (best[0], best[2]):
            best = r
    return best


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """(key, start, length, period) of every run, in words from 0."""
    docs = docs.select(key, text)
    schema = T.StructType([docs.schema[key], *_long("start", "length", "period")])

    def run(batches):
        for b in batches:
            rows = [(k, *r) for k, (_, found) in enumerate(runs_by_text(b.column(text), least, repeats)) for r in found]
            at, *numbers = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in numbers)], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def collapse(docs: DataFrame, text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """docs with every run cut to its first period; other texts stay as they are."""
    names = docs.columns

    def run(batches):
        for b in batches:
            out = b.column(text).to_pylist()
            for k, (words, found) in enumerate(runs_by_text(b.column(text), least, repeats)):
                if found:
                    out[k] = b" ".join(kept(words, found)).decode("utf-8")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else b.column(n) for n in names], names=names)

    return docs.mapInArrow(tidy(run), docs.schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """Per row: key, n_runs, the run of the greatest exponent (start, length, period, exponent_milli; nulls without one), runs_sha256 and collapsed_sha256."""
    docs = docs.select(key, text)
    schema = T.StructType([docs.schema[key], *_long("n_runs", "start", "length", "period", "exponent_milli"), *(T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256"))])
    hashed = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        for b in batches:
            rows = []
            for words, found in runs_by_text(b.column(text), least, repeats):
                top = longest(found)
                best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
                rows.append((len(found), *best, hashed("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), hashed(b" ".join(kept(words, found)))))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)
