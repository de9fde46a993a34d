"""Benchmark decontamination by suffix arrays of the training shards.

Each task cuts its documents into shards of about SHARD words and sorts the
shard's word suffixes (prefix doubling over word codes, until all differ or
the longest window is covered).  Every window of the benchmark - the first
words of each test suffix - is binary-searched in the array; the interval found
holds all its occurrences, whose full 64-bit word hashes are then compared and
extended to the longest verbatim matches.  Nothing is shuffled: documents stay
where they are read.  The benchmark goes to the tasks in blocks of about BLOCK
words, one at a time: a larger benchmark costs a pass over the documents for
each block, with the findings so far written to the shared folder between two
passes, and neither the driver nor a worker holds more than one block.
Windows that items share are searched once, but for the listed matches.
Occurrences are looked at LISTED at a time, so that short items that occur all
over a shard take no more memory than others.

Defined cases: null and empty texts have no words and no hits; items without
words match nothing; an item of fewer words than the window is one window;
items with a null id mark words but are not listed; items that share an id are
listed once; repeated documents are judged alike, each row on its own; columns
other than the named ones pass through ``remove`` untouched and are not read
by ``scan``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.llm.kernels import ALNUM, flat, mix, tidy
from matchlake.llm.tables import saved

WINDOW, SHARD, BLOCK, LISTED = 10, 1 << 19, 4 << 20, 1 << 19
_U = np.uint64


def _codes(words: np.ndarray) -> np.ndarray:
    """30 bits of each word hash, at least 1: two of them fit into one sort key."""
    return (words >> _U(34)).astype(np.int64) + 1


class Items:
    """Test suffixes of a block of the benchmark: word hashes, and per suffix its item, place and window length."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        self.ids = ids
        self.words, at = ALNUM.hashes(*flat(pa.array(texts, pa.string())))
        size = np.diff(at)
        count = np.where(size >= window, size - window + 1, (size > 0).astype(np.int64))
        self.item = np.repeat(np.arange(len(size)), count)
        place = np.arange(len(self.item)) - np.repeat(np.cumsum(count) - count, count)
        self.place = place
        self.start = at[:-1][self.item] + place
        self.length = np.minimum(window, size[self.item])
        self.end = at[1:][self.item]


    def distinct(self) -> Windows:
        """The windows without repetitions."""
        return Windows(self)


class Windows:
    """Each different window once, as a test suffix of its own, with the list of the items that have it.

    Lists that are alike are one, so a passage that many items share is searched
    and marked once, and its items are named once for each document.
    """

    def __init__(self, items: Items):
        self.ids, self.words = items.ids, items.words
        n, reach = len(items.start), int(items.length.max(initial=0))
        gram = items.length.astype(np.uint64)
        for j in range(reach):
            longer = items.length > j
            gram[longer] = mix(gram[longer] * _U(0x9E3779B97F4A7C15) + items.words[items.start[longer] + j])
        _, first, of = np.unique(gram, return_index=True, return_inverse=True)
        rep = first[of]
        same = items.length == items.length[rep]
        for j in range(reach):
            longer = same & (items.length > j)
            same[longer] = items.words[items.start[longer] + j] == items.words[items.start[rep[longer]] + j]
        odd = np.flatnonzero(~same)  # different windows with one hash: each by itself
        of[odd] = len(first) + np.arange(len(odd))
        self.start, self.length = items.start[np.append(first, odd)], items.length[np.append(first, odd)]
        pairs = np.unique(of * max(1, len(items.ids)) + items.item) if n else np.zeros(0, np.int64)
        window, item = pairs // max(1, len(items.ids)), pairs % max(1, len(items.ids))
        cut = np.searchsorted(window, np.arange(len(self.start) + 1))
        known: dict[bytes, int] = {}
        self.lists: list[list[str]] = []
        self.list = np.zeros(len(self.start), np.int64)
        for k, (a, b) in enumerate(pairwise(cut.tolist())):
            at = item[a:b].tobytes()
            if at not in known:
                known[at] = len(self.lists)
                self.lists.append([items.ids[i] for i in item[a:b].tolist() if items.ids[i] is not None])
            self.list[k] = known[at]


class SuffixArray:
    """Word suffixes of a shard, sorted by their first `depth` word codes."""

    def __init__(self, words: np.ndarray, at: np.ndarray, depth: int = WINDOW):
        n = len(words)
        self.words = words
        self.doc_begin, self.doc_end = np.repeat(at[:-1], np.diff(at)), np.repeat(at[1:], np.diff(at))
        self.codes = np.append(_codes(words), np.zeros(depth, np.int64))
        rank, width = self.codes[:n], 1
        self.order = np.argsort(rank, kind="stable")
        while width < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - width)] = rank[width:]
            key = rank * (int(rank.max(initial=0)) + 1) + ahead
            self.order = np.argsort(key)
            ordered = key[self.order]
            new = np.append(True, ordered[1:] != ordered[:-1])[:n]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(new)
            width *= 2
            if new.all():
                break

    def bound(self, items: Items | Windows, upper: bool) -> np.ndarray:
        """Where each suffix's window begins (or ends) among the sorted suffixes."""
        low = np.zeros(len(items.start), np.int64)
        high = np.full(len(items.start), len(self.order), np.int64)
        for _ in range(len(self.order).bit_length()):
            mid = (low + high) >> 1
            open_ = low < high
            at = self.order[np.minimum(mid, len(self.order) - 1)]
            sign = np.zeros(len(low), np.int8)
            for j in range(int(items.length.max())):
                todo = np.flatnonzero((sign == 0) & (items.length > j))
                if not len(todo):
                    break
                q = _codes(items.words[items.start[todo] + j])
                d = self.codes[at[todo] + j]
                sign[todo] = np.where(d < q, -1, d > q)
            right = open_ & ((sign < 0) | (upper & (sign == 0)))
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low

    def matches(self, items: Items | Windows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of (test suffix, shard position) whose windows are the same words of one document, about LISTED at a time."""
        if not len(items.start) or not len(self.order):
            return
        low, high = self.bound(items, False), self.bound(items, True)
        found = np.flatnonzero(high > low)
        count = (high - low)[found]
        total = np.cumsum(count) - count
        cuts = np.flatnonzero(np.append(True, np.diff(total // LISTED) > 0)[: len(found)])
        for a, z in pairwise([*cuts.tolist(), len(found)]):
            n, base = count[a:z], found[a:z]
            suffix = np.repeat(base, n)
            at = self.order[np.arange(len(suffix)) - np.repeat(np.cumsum(n) - n, n) + low[suffix]]
            good = at + items.length[suffix] <= self.doc_end[at]
            suffix, at = suffix[good], at[good]
            for j in range(int(items.length[base].max(initial=0))):
                same = (items.length[suffix] <= j) | (items.words[np.minimum(items.start[suffix] + j, len(items.words) - 1)] == self.words[np.minimum(at + j, len(self.words) - 1)])
                if not same.all():
                    suffix, at = suffix[same], at[same]
            if len(at):
                yield suffix, at

    def heads(self, items: Items, suffix: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which matches don't go on to the left, in item and document."""
        on = (items.place[suffix] > 0) & (at > self.doc_begin[at])
        on[on] = items.words[items.start[suffix[on]] - 1] == self.words[at[on] - 1]
        return ~on

    def longest(self, items: Items, suffix: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many words each match goes on for, within its item and document."""
        length = items.length[suffix].copy()
        go = np.arange(len(suffix))
        while len(go):
            i, d = items.start[suffix[go]] + length[go], at[go] + length[go]
            on = (i < items.end[suffix[go]]) & (d < self.doc_end[at[go]])
            on[on] = items.words[i[on]] == self.words[d[on]]
            go = go[on]
            length[go] += 1
        return length


def _shards(at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[tuple[Items, bool]]:
    """The benchmark in blocks of about BLOCK words, each with whether it is the last."""
    ids, texts, size, before = [], [], 0, None
    for r in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        if size >= BLOCK:
            if before is not None:
                yield before, False
            before = Items(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "") // 4
    if before is not None:
        yield before, not ids
    if ids or before is None:
        yield Items(ids, texts, window), True


_MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_at", T.LongType()), T.StructField("doc_at", T.LongType()), T.StructField("n_words", T.LongType())])
_ARROW = pa.struct([("item_id", pa.string()), ("item_at", pa.int64()), ("doc_at", pa.int64()), ("n_words", pa.int64())])


def _covered(words: np.ndarray, at: np.ndarray, windows: Windows):
    """Of a shard's documents: which words are hit, and the items found."""
    cover = np.zeros(len(words) + 1, np.int64)
    found: list[set] = [set() for _ in range(len(at) - 1)]
    array = SuffixArray(words, at, int(windows.length.max(initial=1)))
    for window, d in array.matches(windows):
        np.add.at(cover, d, 1)
        np.add.at(cover, d + windows.length[window], -1)
        pair = np.unique((np.searchsorted(at, d, "right") - 1) * len(windows.lists) + windows.list[window])
        for k, i in zip((pair // len(windows.lists)).tolist(), (pair % len(windows.lists)).tolist(), strict=True):
            found[k].update(windows.lists[i])
    return np.cumsum(cover[:-1]) > 0, found, [[] for _ in found]


def _judged(words: np.ndarray, at: np.ndarray, items: Items):
    """As _covered, with the matches of each item, which are as many as items have the passage."""
    cover = np.zeros(len(words) + 1, np.int64)
    found: list[set] = [set() for _ in range(len(at) - 1)]
    spans: list[list] = [[] for _ in range(len(at) - 1)]
    array = SuffixArray(words, at, int(items.length.max(initial=1)))
    for suffix, d in array.matches(items):
        np.add.at(cover, d, 1)
        np.add.at(cover, d + items.length[suffix], -1)
        doc = np.searchsorted(at, d, "right") - 1
        pair = np.unique(doc * len(items.ids) + items.item[suffix])
        for k, i in zip((pair // len(items.ids)).tolist(), (pair % len(items.ids)).tolist(), strict=True):
            if items.ids[i] is not None:
                found[k].add(items.ids[i])
        head = array.heads(items, suffix, d)
        s, p, doc = suffix[head], d[head], doc[head]
        for i, a, k, x, n in zip(items.item[s].tolist(), items.place[s].tolist(), doc.tolist(), (p - at[doc]).tolist(), array.longest(items, s, p).tolist(), strict=True):
            spans[k].append({"item_id": items.ids[i], "item_at": a, "doc_at": x, "n_words": n})
    return np.cumsum(cover[:-1]) > 0, found, spans


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", listed: bool = True) -> DataFrame:
    """One row per document: key, n_words, n_hit (words inside occurring windows), item_ids (sorted strings) and matches.

    matches: array of (item_id, item_at, doc_at, n_words), the longest verbatim
    matches of at least a window, by word positions; left- and right-maximal.
    Without `listed` the column is left out.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), *([T.StructField("matches", T.ArrayType(_MATCH))] if listed else [])])
    state = T.StructType([*rows.schema.fields, T.StructField("cover", T.BinaryType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(_MATCH))])

    def passed(shared, first: bool, last: bool):
        def run(batches):
            for b in batches:
                words, at = ALNUM.hashes(*flat(b.column("_text")))
                hits, ids, spans = [], [], []
                for lo, hi in _shards(at, SHARD):
                    h, i, s = (_judged if listed else _covered)(words[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], shared.value)
                    hits.append(h)
                    ids += i
                    spans += s
                hit = np.concatenate(hits) if hits else np.zeros(0, bool)
                if not first:
                    for k, (c, i, s) in enumerate(zip(*(b.column(x).to_pylist() for x in ("cover", "item_ids", "matches")), strict=True)):
                        hit[at[k] : at[k + 1]] |= np.unpackbits(np.frombuffer(c, np.uint8), count=int(at[k + 1] - at[k])).astype(bool)
                        ids[k].update(i)
                        spans[k] += s
                found = pa.array([sorted(x) for x in ids], pa.list_(pa.string()))
                lists = pa.array([sorted(x, key=lambda m: (m["doc_at"], m["item_id"] or "", m["item_at"])) for x in spans], pa.list_(_ARROW))
                if last:
                    total = np.append(0, np.cumsum(hit))
                    columns = [b.column("_key"), pa.array(np.diff(at).astype(np.int64)), pa.array((total[at[1:]] - total[at[:-1]]).astype(np.int64)), found]
                    yield pa.RecordBatch.from_arrays(columns + [lists] * listed, names=out.names)
                else:
                    cover = [np.packbits(hit[x:y]).tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_text"), pa.array(cover, pa.binary()), found, lists], names=state.names)

        return tidy(run)

    first = True
    for block, last in _blocks(benchmark, item, item_text, window):
        shared = docs.sparkSession.sparkContext.broadcast(block if listed else block.distinct())
        rows = rows.mapInArrow(passed(shared, first, last), out if last else state)
        if not last:
            rows = saved(rows)
            shared.unpersist()
        first = False
    return rows


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any occurring window, all columns as they were. Every row is judged where it is read."""

    def passed(shared):
        def run(batches):
            for b in batches:
                words, at = ALNUM.hashes(*flat(b.column(text)))
                keep = np.ones(len(at) - 1, bool)
                for lo, hi in _shards(at, SHARD):
                    array = SuffixArray(words[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], int(shared.value.length.max(initial=1)))
                    for _, d in array.matches(shared.value):
                        keep[lo + np.searchsorted(at[lo : hi + 1] - at[lo], d, "right") - 1] = False
                yield b.filter(pa.array(keep))

        return tidy(run)

    for block, last in _blocks(benchmark, item, item_text, window):
        shared = docs.sparkSession.sparkContext.broadcast(block.distinct())
        docs = docs.mapInArrow(passed(shared), docs.schema)
        if not last:
            docs = saved(docs)
            shared.unpersist()
    return docs
