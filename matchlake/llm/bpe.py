"""Byte-level BPE encoding and decoding.

A pre-token's bytes are read as Latin-1 text so that an Aho-Corasick automaton
over the vocabulary finds, at every byte, the longest token that starts there.
Encoding goes left to right and takes the longest match whose pair with the
token before it is *compatible*: encoding the two tokens' joined bytes would
give exactly these two tokens again.  If no candidate fits, the last token is
taken back and its next shorter prefix token is tried; positions from which
the rest can't be encoded are remembered, so that no position is left twice
and the work is linear in the bytes.  A sequence whose adjacent pairs are all
compatible is the one that the merges by rank give, and it is unique.

Texts: null and empty texts have no tokens; white space and repeated rows
need no care; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from matchlake.llm.kernels import held, tidy

#: Pre-tokens of up to SHORT characters, and pairs of tokens, that a worker remembers; beyond it either memory starts anew.
MEMO, SHORT = 1 << 18, 32
#: Characters that are split into pre-tokens at once, about.
PIECE = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encodes by one rank table. Not tied to Spark; a task builds its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.token = {r: b for b, r in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}  # the two tokens that a token was merged from
        self.fits_memo: dict[int, bool] = {}  # by left << 32 | right
        self.shorter: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.memo: dict[str, bytes] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The last merge that makes the token from its bytes; None for a single byte or unreachable token."""
        if token not in self.parts:
            b, found = self.token[token], None
            for k in range(1, len(b)):
                left, right = self.ranks.get(b[:k]), self.ranks.get(b[k:])
                if left is not None and right is not None and left < token and right < token and self.fits(left, right, token):
                    found = (left, right)
                    break
            self.parts[token] = found
        return self.parts[token]

    def fits(self, left: int, right: int, limit: int | None = None) -> bool:
        """No merge of a rank under limit crosses the border between the two tokens.

        Undo merges of the two sides from the highest rank on: a crossing
        merge that comes before the last of them would have been done first.
        """
        key = left << 32 | right
        if limit is None:
            known = self.fits_memo.get(key)
            if known is not None:
                return known
        top, a, b, good = limit if limit is not None else 1 << 60, left, right, True
        while True:
            across = self.ranks.get(self.token[a] + self.token[b])
            if across is not None and across < top:
                good = False
                break
            left_parts, right_parts = self.halves(a), self.halves(b)
            if left_parts and (a > b or not right_parts):
                top, a = a, left_parts[1]
            elif right_parts:  # of equal ranks the left one is merged first, so a crossing merge may tie
                top, b = b + 1, right_parts[0]
            else:
                break
        if limit is None:
            if len(self.fits_memo) >= MEMO:
                self.fits_memo.clear()
            self.fits_memo[key] = good
        return good

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if none."""
        if token not in self.shorter:
            b = self.token[token]
            self.shorter[token] = next((self.ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ranks), -1)
        return self.shorter[token]

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Tokens of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - len(self.token[token])
            if longest[start] < 0 or len(self.token[token]) > len(self.token[longest[start]]):
                longest[start] = token
        out: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token = 0, longest[0]
        while True:
            while token >= 0:
                end = at + len(self.token[token])
                if not dead[end] and (not out or self.fits(out[-1], token)):
                    break
                token = self.prefix(token)
            if token < 0:
                dead[at] = 1
                if not out:
                    raise ValueError("these bytes have no encoding")
                token = out.pop()
                at -= len(self.token[token])
                token = self.prefix(token)
                continue
            out.append(token)
            at = end
            if at == len(piece):
                return out
            token = longest[at]

    def packed(self, piece: str) -> bytes:
        """A pre-token's ids as little-endian unsigned 32-bit integers."""
        found = self.memo.get(piece)
        if found is None:
            ids = self.encode_bytes(piece.encode("utf-8"))
            found = b"".join(i.to_bytes(4, "little") for i in ids)
            if len(piece) <= SHORT:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[piece] = found
        return found

    def encode_packed(self, text: str) -> bytes:
        memo, out = self.memo, []
        for part in pieces(text):
            found = self.split(part)
            try:
                out.append(b"".join([memo[p] for p in found]))
            except KeyError:
                out.append(b"".join([memo.get(p) or self.packed(p) for p in found]))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode_packed(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in memoryview(ids).cast("I").tolist()])


def pieces(text: str) -> Iterator[str]:
    """The text cut where any tokenization of it is cut too: before a space between a letter of a to z and a character that is no white space."""
    lo = 0
    while len(text) - lo > PIECE:
        hi = lo + PIECE
        while hi < len(text) and not (text[hi] == " " and "a" <= text[hi - 1] <= "z" and hi + 1 < len(text) and not text[hi + 1].isspace()):
            hi += 1
        yield text[lo:hi]
        lo = hi
    if lo < len(text):
        yield text[lo:]


def codec(path: str, pattern: str) -> Codec:
    """The codec of a vocabulary, kept by the worker process while it encodes."""
    return held(("codec", path, pattern), lambda: Codec(read_ranks(path), pattern))


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    gone = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in gone] + list(fields))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with the column `ids`: array<int> of the text's token ids. A column of that name is replaced."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            packed = [c.encode_packed(t) if t else b"" for t in b.column(text).to_pylist()]
            at = [0]
            for p in packed:
                at.append(at[-1] + len(p) // 4)
            flat = pa.Array.from_buffers(pa.int32(), at[-1], [None, pa.py_buffer(b"".join(packed))])
            made = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)
            keep = [n for n in b.schema.names if n.lower() != ids.lower()]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [made], names=[*keep, ids])

    return df.mapInArrow(tidy(run, holds=True), _with(df.schema, T.StructField(ids, T.ArrayType(T.IntegerType()))))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the column `out`: binary, the bytes of the ids. Null ids give null; an unknown id is an error."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            made = pa.array([None if x is None else b"".join([c.token[i] for i in x]) for x in b.column(ids).to_pylist()], pa.binary())
            keep = [n for n in b.schema.names if n.lower() != out.lower()]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [made], names=[*keep, out])

    return df.mapInArrow(tidy(run, holds=True), _with(df.schema, T.StructField(out, T.BinaryType())))


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 and decoded_sha256 of a whole encoding and its decoding."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            n, ids, back = [], [], []
            for t in b.column(text):
                t = t.as_py()
                packed = c.encode_packed(t) if t else b""
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(c.decode_packed(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(tidy(run, holds=True), schema)
