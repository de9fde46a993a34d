from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from matchlake.llm import bpe, token_counts
from matchlake.llm.kernels import flat

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "e", "th", " ", "  ", "\n", "'s", "'", "'re", "'ll", "'l", "1", "é", "中", "😀", "\x1c", "\x85", " ", "​", "ing", "the", "\t", "!!", "zz", "<|endoftext|>", "<|end"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    made += ["".join(rng.choice("abcdeinghstrou") for _ in range(n)) for n in (300, 2000)] + ["a" * 3000, "ab" * 900, " " * 700 + "x", "\n" * 400]
    return [*made, None, "", "x " * 90_000]


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_encoding_equals_the_library(texts, theirs):
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for t in texts:
        ids = c.encode_packed(t) if t else b""
        assert memoryview(ids).cast("I").tolist() == theirs.encode_ordinary(t or "")
        assert c.decode_packed(ids) == (t or "").encode()


def test_every_character_splits_alike(theirs):
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for p in [*range(0x3000), *range(0xA000, 0xA100), *range(0x1F600, 0x1F650), 0x10FFFF]:
        t = "a" + chr(p) + "b " + chr(p) + "\n"
        assert c.encode(t) == theirs.encode_ordinary(t)


def test_frames(spark, texts, theirs):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)
    for r in bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect():
        ids = np.array(theirs.encode_ordinary(texts[r["doc_id"]] or ""), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    small = df.where("doc_id < 50")
    back = bpe.decode(bpe.encode(small, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert back.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
    assert bpe.digests(df.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_counts_equal_the_library(spark, texts, monkeypatch):
    want = [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, JSON).collect()}
    assert got == {i: (len((t or "").encode()), n) for i, (t, n) in enumerate(zip(texts, want, strict=True))}
    monkeypatch.setattr(token_counts, "CHUNK", 7)  # most pre-tokens have several chunks
    assert token_counts.Counter(JSON).texts(*flat(pa.array(texts, pa.string()))).tolist() == want


def test_chunk_maps_compose(monkeypatch):
    rng = random.Random(8)
    long = ["".join(rng.choice(letters) for _ in range(n)) for n in (17, 300, 2000) for letters in ("ab", "a", "etaoinshr", "é中x")]
    long += ["ab" * 900, "abc" * 500 + "q", "!" * 1500, "the" * 400, " " * 900 + "end"]
    want = [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch(long, add_special_tokens=False)]
    flat_texts = flat(pa.array([t for t in long for _ in range(2)], pa.string()))  # every row twice
    for chunk in (5, 32, 256):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        c = token_counts.Counter(JSON)
        assert c.texts(*flat_texts).tolist() == [n for n in want for _ in range(2)]
    monkeypatch.setattr(token_counts, "STATES", 10)  # tables dropped before each pass
    assert c.texts(*flat_texts).tolist() == [n for n in want for _ in range(2)]


def test_equal_chunks_share_a_map():
    t = token_counts.Counter(JSON).transducer
    data = np.frombuffer(b"a" * 256 * 100, np.uint8)
    at, none = np.arange(100) * 256, np.zeros(1, np.int64)
    key, leave, _ = t.maps(data, at, np.full(100, 256), at == at[-1])
    assert len(np.unique(key & 0xFFFFFFFF)) < 20 and set(leave) <= set(key & 0xFFFFFFFF)
    assert t.composed(data, none, none + len(data)).tolist() == t.run(data, none, none + len(data), none)[1].tolist()


def test_counts_of_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens string")
    got = token_counts.token_counts(empty, JSON)
    assert got.collect() == [] and got.columns[:3] == ["doc_id", "n_bytes", "n_tokens"]
