"""Vectorised text kernels shared by the corpus operators.

They turn an Arrow string column into flat numpy arrays: one 64-bit hash per
word and the word ranges of every document.  Work goes on in pieces of about
``PIECE`` bytes, so a batch or one very long text needs bounded scratch memory
(eight bytes for each word are kept).  Hashes depend on the bytes of the word
alone: the same word hashes alike in every task, run and cluster.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64
_HELD: dict[tuple, object] = {}
_LIBC = ctypes.CDLL(None)


def held(key: tuple, make: Callable[[], object]):
    """The object of this key in a worker process, made when first asked for; a worker holds one at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def released() -> None:
    """Gives memory that is free inside this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidy(run: Callable, holds: bool = False) -> Callable:
    """run, a function over Arrow batches, for workers that many operators use in turn.

    Tables held for other operators are dropped first (unless run `holds` some
    itself), and free memory is given back after every batch.
    """

    def tidied(batches):
        if not holds:
            _HELD.clear()
        for out in run(batches):
            yield out
            del out
            released()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """As tidy, for a function of a group's table; small groups are not worth the calls."""

    def tidied(table: pa.Table) -> pa.Table:
        _HELD.clear()
        out = run(table)
        if table.nbytes > 1 << 20:
            released()
        return out

    return tidied


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The packed values of a binary column's rows in a row, without a Python object for each row; nulls hold none."""
    if isinstance(column, pa.Array):
        column = pa.chunked_array([column])
    parts = []
    for c in column.chunks:
        data, at = flat(c)
        parts.append(data[at[0] : at[-1]])
    return np.concatenate(parts).view(kind) if parts else np.zeros(0, kind)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply rounds)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed << 32)) * _U(0x9E3779B97F4A7C15))


_PLACE = stream(4096, 2) | _U(1)
_STEP = stream(64, 3) | _U(1)
_BYTE_STREAM = stream(16, 4) | _U(1)


class Words:
    """Which bytes form words, and whether A-Z counts as a-z."""

    def __init__(self, separators: bytes, lower: bool):
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(separators)] = False
        self.value = stream(256, 1)
        if lower:
            self.value[65:91] = self.value[97:123]
            self.inside[65:91] = self.inside[97:123]
        self.value[~self.inside] = 0

    def pieces(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """Byte ranges of about PIECE bytes that end between words."""
        lo, end = int(at[0]), int(at[-1])
        while lo < end:
            hi = min(lo + PIECE, end)
            if hi < end:
                k = int(np.searchsorted(at, hi, "right")) - 1
                if at[k] > lo:
                    hi = int(at[k])
                else:
                    stop = int(at[k + 1])
                    while hi < stop and self.inside[data[hi]]:
                        more = np.flatnonzero(~self.inside[data[hi : min(hi + PIECE, stop)]])
                        hi = hi + int(more[0]) if len(more) else min(hi + PIECE, stop)
            yield lo, hi
            lo = hi

    def hashes(self, data: np.ndarray, at: np.ndarray, spans: bool = False):
        """Word hashes of all documents in a row, and where each document's words begin.

        With ``spans`` also the first byte of each word and the byte after its last.
        """
        found, firsts, lasts = [], [], []
        for lo, hi in self.pieces(data, at):
            b = data[lo:hi]
            inside = self.inside[b]
            begin = inside.copy()
            begin[1:] &= ~inside[:-1]
            cut = at[(at > lo) & (at < hi)] - lo
            begin[cut] |= inside[cut]
            start = np.flatnonzero(begin)
            if not len(start):
                continue
            place = np.arange(len(b), dtype=np.int32)
            place -= np.repeat(np.concatenate(([0], start)).astype(np.int32), np.diff(np.concatenate(([0], start, [len(b)]))))
            value = self.value[b]
            value *= _PLACE[place & 4095]
            if len(b) > 4096 and int(place[inside].max()) > 4095:
                value *= (place >> 12).astype(np.uint64) * _U(2) + _U(1)
            size = np.add.reduceat(inside, start, dtype=np.int64)
            found.append(mix(np.add.reduceat(value, start) + size.astype(np.uint64) * _STEP[63]))
            firsts.append(start + lo)
            if spans:
                lasts.append(start + lo + size)
        h = np.concatenate(found) if found else np.zeros(0, np.uint64)
        first = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        offsets = np.searchsorted(first, at)
        if not spans:
            return h, offsets
        return h, offsets, first, np.concatenate(lasts) if lasts else np.zeros(0, np.int64)


SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Words between ASCII white space; as they are, and with A-Z as a-z.
PLAIN = Words(SPACE, lower=False)
LOWER = Words(SPACE, lower=True)
#: Words of ASCII letters, digits and everything beyond ASCII, A-Z as a-z.
ALNUM = Words(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), lower=True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(at: np.ndarray, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `size` bytes (or whatever `at` counts)."""
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values; k - 1 fewer than h has (none if h is short)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += h[j : j + n] * _STEP[j]
    return mix(out)


def long_grams(h: np.ndarray, k: int) -> np.ndarray:
    """As grams, by doubling: about log2(k) passes instead of k."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    powers, width = {1: h}, 1
    while width * 2 <= k:
        p = powers[width]
        powers[width * 2] = mix(p[: len(p) - width] * _STEP[width.bit_length()] + p[width:])
        width *= 2
    n, out, done = len(h) - k + 1, None, 0
    for w in sorted(powers, reverse=True):
        if k - done >= w:
            part = powers[w][done : done + n]
            out = part.copy() if out is None else mix(out * _STEP[40 + w.bit_length()] + part)
            done += w
    return out


def shingle_sets(h: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each document; fewer words: the whole sequence as one."""
    every = grams(h, k)
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(every[a : b - k + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            sets.append(mix(grams(h[a:b], b - a) + _STEP[50 + b - a]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` consecutive values."""
    if len(x) < width:
        return x[:0]
    w, m = 1, x
    while w * 2 <= width:
        m = np.minimum(m[: len(m) - w], m[w:])
        w *= 2
    n = len(x) - width + 1
    return np.minimum(m[:n], m[width - w : width - w + n])
