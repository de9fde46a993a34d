"""Token counts by compiled finite-state transducers.

Two deterministic transducers run one after the other.

*Borders.*  The byte-level pre-tokenizer is a finite-state rule over character
classes (letter, number, blank, other white space, the rest).  ``borders``
marks the first character of each pre-token of a whole batch at once.

*Counts.*  ``Transducer`` reads a pre-token's bytes.  Its state is all that
later steps can depend on: the longest suffix read that still is a prefix of
some token, and the last token and relative token count at each position
inside this suffix.  Each transition carries the change of the number of
emitted tokens, so a count is the sum along the path.  Transitions are
compiled when they are first met, and kept.

*Chunks.*  Many pre-tokens advance in lockstep.  A long pre-token is cut into
chunks, and each chunk gets a state map: entry state to exit state and count,
over the states that can be met at its front.  These are the root and, until
nothing new appears, the exits of the map of the chunk before it; all new
entries of a round run in parallel.  The maps are then composed by doubling: after k rounds a map spans 2^k chunks, and the map of a whole
pre-token, applied to the root, gives its count.  A border resets the state,
so that the counts of a text's pre-tokens simply add up.

Texts: null and empty texts have 0 tokens; a text of any length is read whole;
repeated rows count alike.  A special token's string inside a text is one
token, as in the library's default.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from matchlake.llm.bpe import Codec
from matchlake.llm.kernels import _PLACE, _STEP, flat, held, mix, stream, tidy

LETTER, NUMBER, REST, BLANK, WHITE = range(5)
_BYTE = stream(256, 7)
#: Bytes of text per pass; chunk length of long pre-tokens; distinct pre-tokens and states remembered.
PIECE, CHUNK, MEMO, STATES = 1 << 20, 256, 1 << 20, 1 << 19
_U = np.uint64


def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, REST, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            out[[ord(c) for c in every[a:b]]] = kind
    out[0x20] = BLANK
    return out


def borders(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks the characters that begin a pre-token. first: marks the characters that begin a text."""
    n = len(points)
    last = np.append(first[1:], True)
    white = kind >= BLANK
    before = np.append(np.uint8(255), kind[:-1])
    after_white = np.append(white[1:], False)
    new = first | (before == WHITE) | ((before != kind) & (before != BLANK))
    opens = first | ~np.append(False, white[:-1])
    out = np.where(white, opens | (~last & ~after_white), new)
    quote = np.flatnonzero(out & (points == 39) & ~last)
    if len(quote):
        pad = np.append(points, np.zeros(3, points.dtype))
        end = np.append(first, np.ones(3, bool))  # the next text, or the end
        one = quote[np.isin(pad[quote + 1], [ord(c) for c in "stmd"])]
        two = quote[~end[quote + 2] & np.isin(pad[quote + 1].astype(np.int64) * 128 + np.minimum(pad[quote + 2], 127), [ord(a) * 128 + ord(b) for a, b in ("re", "ve", "ll")])]
        out = np.append(out, np.zeros(3, bool))
        out[one + 1] = False
        out[two + 1] = out[two + 2] = False
        out[one + 2] = True
        out[two + 3] = True
        out = out[:n]
    return out


class Transducer:
    """Counts the tokens of byte strings by a rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.codec = Codec(ranks, r"")
        self.ranks = ranks
        self.open = {b[:k] for b in ranks for k in range(1, len(b) + 1)}  # prefixes of tokens
        self.forget()

    def forget(self) -> None:
        """Drops the compiled states and transitions."""
        root = (b"", (-1,), (0,))
        self.ids, self.states = {root: 0}, [root]
        none = np.zeros(0, np.int64)
        self.old = self.new = (none, none, none)  # transitions: state * 256 + byte (sorted), next state, change of the count

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change of the count."""
        tail, lasts, counts = self.states[state]
        tail += bytes((byte,))
        chosen = None
        for m in range(len(tail), 0, -1):
            token = self.ranks.get(tail[-m:])
            if token is not None:
                at = len(lasts) - m  # the position before the token
                if lasts[at] < 0 or self.codec.fits(lasts[at], token):
                    chosen, count = token, counts[at] + 1
                    break
        if chosen is None:
            raise ValueError("these bytes have no encoding")
        while tail and tail not in self.open:
            tail = tail[1:]
        lasts, counts = (*lasts, chosen), (*counts, count)
        keep = len(tail) + 1
        new = (tail, lasts[-keep:], tuple(c - count for c in counts[-keep:]))
        to = self.ids.get(new)
        if to is None:
            to = self.ids[new] = len(self.states)
            self.states.append(new)
        return to, count

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of the count; transitions not met before are compiled."""
        key = state * 256 + byte
        to, delta = np.empty_like(key), np.empty_like(key)
        left = _looked_up(self.old, key, np.arange(len(key)), to, delta)
        left = _looked_up(self.new, key, left, to, delta)
        if len(left):
            keys = np.unique(key[left])
            made = np.array([self.compile(int(k) >> 8, int(k) & 255) for k in keys], np.int64)
            self.new = _merged(self.new, (keys, made[:, 0], made[:, 1]))
            _looked_up(self.new, key, left, to, delta)
            if 8 * len(self.new[0]) > len(self.old[0]):  # large tables are seldom copied
                self.old, self.new = _merged(self.old, self.new), tuple(x[:0] for x in self.new)
        return to, delta

    def run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and count changes of many byte ranges that advance in lockstep."""
        order = np.argsort(-size, kind="stable")
        start, size, state = start[order], size[order], state[order].copy()
        total = np.zeros(len(start), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, "left"))
            state[:n], d = self.step(state[:n], data[start[:n] + k].astype(np.int64))
            total[:n] += d
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def counts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Token counts of byte ranges, each one pre-token."""
        if len(self.states) > STATES:
            self.forget()
        out = np.zeros(len(start), np.int64)
        long = size > CHUNK
        out[~long] = self.run(data, start[~long], size[~long], np.zeros((~long).sum(), np.int64))[1]
        if long.any():
            out[long] = self.composed(data, start[long], size[long])
        return out

    def maps(self, data: np.ndarray, at: np.ndarray, length: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State maps of chunks: (chunk << 32 | entry state, sorted; exit state; count).

        last: marks chunks that end a pre-token. A chunk's map holds the root and the exits of the map
        of the chunk before it. Chunks of equal bytes run only once from a state.
        """
        rows = data[np.minimum(at[:, None] + np.arange(CHUNK), len(data) - 1)]
        rows[np.arange(CHUNK) >= length[:, None]] = 0
        rows = np.column_stack((rows, (length - 1).astype(np.uint8)))
        _, one, shape = np.unique(rows.view(f"V{CHUNK + 1}").ravel(), return_index=True, return_inverse=True)
        todo = np.arange(len(at)) << 32
        nodes, ran = todo[:0], (todo[:0], todo[:0], todo[:0])
        while len(todo):
            wanted = shape[todo >> 32] << 32 | todo & 0xFFFFFFFF
            new = np.setdiff1d(wanted, ran[0])
            ran = _merged(ran, (new, *self.run(data, at[one][new >> 32], length[one][new >> 32], new & 0xFFFFFFFF)))
            nodes = np.insert(nodes, np.searchsorted(nodes, todo), todo)
            on = ~last[todo >> 32]
            leave = ran[1][np.searchsorted(ran[0], wanted[on])]
            todo = np.setdiff1d(((todo[on] >> 32) + 1) << 32 | leave, nodes)
        which = np.searchsorted(ran[0], shape[nodes >> 32] << 32 | nodes & 0xFFFFFFFF)
        return nodes, ran[1][which], ran[2][which]

    def composed(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Token counts of long pre-tokens, by the composed state maps of their chunks."""
        parts = -(-size // CHUNK)
        head = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(start)), parts)
        number = np.arange(len(owner)) - head[owner]
        last = number == parts[owner] - 1
        key, leave, total = self.maps(data, start[owner] + number * CHUNK, np.minimum(CHUNK, size[owner] - number * CHUNK), last)
        end = len(key)
        go = np.flatnonzero(~last[key >> 32])
        to = np.full(end + 1, end)
        to[go] = np.searchsorted(key, ((key[go] >> 32) + 1) << 32 | leave[go])
        total = np.append(total, 0)
        for _ in range(int(parts.max() - 1).bit_length()):  # each map followed by the map it leads to
            total = total + total[to]
            to = to[to]
        return total[np.searchsorted(key, head << 32)]


def _looked_up(table, key: np.ndarray, rows: np.ndarray, to: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """Fills to and delta for the rows whose key the table holds; the other rows."""
    keys = table[0]
    if not len(keys) or not len(rows):
        return rows
    k = key[rows]
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    has = keys[at] == k
    to[rows[has]], delta[rows[has]] = table[1][at[has]], table[2][at[has]]
    return rows[~has]


def _merged(one, two):
    """Two tables with sorted keys as one."""
    at = np.searchsorted(one[0], two[0])
    return tuple(np.insert(x, at, y) for x, y in zip(one, two, strict=True))


class Counter:
    """Token counts of texts by a tokenizers JSON file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in enumerate(_printable())}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks, order = {}, {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            order[a + b] = 256 + k
        for token in spec["model"]["vocab"]:
            if token not in special:
                b = bytes(letters[c] for c in token)
                ranks[b] = order[token] if len(b) > 1 else b[0]
        self.transducer, self.kind = Transducer(ranks), classes()
        self.special = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(special, key=len, reverse=True))) if special else None
        self.hash, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def known(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Counts of pre-tokens; those not met before go through the transducer."""
        u, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, u)
        old = at < len(self.hash)
        old[old] = self.hash[at[old]] == u[old]
        got = np.zeros(len(u), np.int64)
        got[old] = self.count[at[old]]
        if not old.all():
            got[~old] = self.transducer.counts(data, start[one[~old]], size[one[~old]])
            if len(self.hash) > MEMO:
                self.hash, self.count, at = u[:0], got[:0], at * 0
            self.hash = np.insert(self.hash, at[~old], u[~old])
            self.count = np.insert(self.count, at[~old], got[~old])
        return got[inverse]

    def texts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(at) - 1, np.int64)
        cuts, gone = [at], [at[:0]]
        if self.special:
            for m in self.special.finditer(memoryview(data[at[0] : at[-1]]) if len(data) else b""):
                a, b = m.start() + at[0], m.end() + at[0]
                k = int(np.searchsorted(at, a, "right")) - 1
                if b <= at[k + 1]:
                    out[k] += 1
                    cuts.append(np.array([a, b]))
                    gone.append(np.array([a]))
        begin = np.unique(np.concatenate(cuts))
        skip = np.isin(begin[:-1], np.concatenate(gone))
        lo, end = 0, len(begin) - 1
        while lo < end:  # whole texts (or what specials leave of them), about PIECE bytes at once
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + PIECE, "right")) - 1)
            self._part(data, begin[lo : hi + 1], skip[lo:hi], at, out)
            lo = hi
        return out

    def _part(self, data, begin, skip, at, out) -> None:
        base, b = int(begin[0]), data[begin[0] : begin[-1]]
        if not len(b):
            return
        points = np.frombuffer(b.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        byte = np.flatnonzero((b & 0xC0) != 0x80)
        first = np.zeros(len(points), bool)
        starts = begin[:-1][begin[:-1] < begin[-1]] - base
        first[np.searchsorted(byte, starts)] = True
        start = byte[borders(points, self.kind[points], first)]
        size = np.diff(np.append(start, len(b)))
        place = np.arange(len(b)) - np.repeat(start, size)
        value = _BYTE[b] * _PLACE[place & 4095] * ((place >> 12).astype(np.uint64) * _U(2) + _U(1))
        h = mix(np.add.reduceat(value, start) + size.astype(np.uint64) * _STEP[62])
        count = self.known(h, b, start, size)
        if skip.any():
            part = np.searchsorted(begin - base, start, "right") - 1
            count[skip[np.minimum(part, len(skip) - 1)]] = 0
        owner = np.searchsorted(at, start + base, "right") - 1
        np.add.at(out, owner, count) if len(at) < 3 else out.__iadd__(np.bincount(owner, count, len(out)).astype(np.int64))


def _printable() -> list[str]:
    """The characters that stand for the bytes 0 to 255 in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def counter(path: str) -> Counter:
    """The counter of a vocabulary, kept by the worker process while it counts."""
    return held(("counter", path), lambda: Counter(path))


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes (UTF-8) and n_tokens of the whole text. Other columns are not read."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        c = counter(path)
        for b in batches:
            data, at = flat(b.column(text))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(np.diff(at)), pa.array(c.texts(data, at))], names=[key, "n_bytes", "n_tokens"])

    return df.select(key, text).mapInArrow(tidy(run, holds=True), schema)
