"""Chunked byte-level BPE against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from volfuse.llm import chunked_bpe, queries
from volfuse.llm.texts import text_bytes

PATH = public_tokenizers.path(queries.BYTE_TOKENIZER)
PART = st.sampled_from(
    ["'", "'s", "'ll", "s", "t", " ", "  ", "\n", "\r\n", "\t", "\xa0", "　", "!", "1", "é", "漢", "😀", " the", "Straße", "<|endoftext|>", "<|endof", "\x1c", "́"]
)


@pytest.fixture
def coder():
    return chunked_bpe.ChunkedBpe(PATH)


def encoded(coder, rows):
    raw, at = text_bytes(pa.array(rows, pa.string()))
    ids, bounds = coder.encode(raw, at)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


def library(coder, text):
    return coder.tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("zeros", "longest"), [(9, 1 << 14), (2, 37), (1, 5)])
def test_equals_library(monkeypatch, coder, zeros, longest):
    plain = chunked_bpe.rolling_cuts
    monkeypatch.setattr(chunked_bpe, "rolling_cuts", lambda raw, at: plain(raw, at, zeros, longest))

    @settings(deadline=None, max_examples=150)
    @given(st.lists(st.lists(PART, max_size=60).map("".join), max_size=5))
    def check(rows):
        assert encoded(coder, [*rows, None]) == [library(coder, t) for t in [*rows, None]]

    check()


def test_every_character(coder):
    text = "".join(f"x{c}x {c} 1{c}{c}'s" for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))
    assert encoded(coder, [text])[0] == library(coder, text)


def test_joins_are_repaired(monkeypatch, coder):
    """Chunks alone give other ids than the text; the repaired joins don't."""
    text = "internationalization of unbelievable misunderstandings " * 20
    raw, at = text_bytes(pa.array([text]))
    cuts = np.arange(0, len(raw) + 1, 11)
    cuts = np.union1d(cuts, at)
    alone = coder.from_chunks(raw, cuts)
    assert alone.tolist() != library(coder, text)
    assert coder.repaired(raw, at, cuts, alone)[0].tolist() == library(coder, text)


def test_wrong_ids_beside_a_join_widen_the_range(coder):
    """A range ends only where the ids beside it agree: ids spoilt over three units are all replaced."""
    text = "one two three four five six seven eight nine ten"
    raw, at = text_bytes(pa.array([text]))
    cuts = np.array([0, text.index("six") + 1, len(raw)])
    ids = coder.from_chunks(raw, cuts)
    start = np.cumsum(coder.size[ids]) - coder.size[ids]
    near = (start >= text.index(" four")) & (start < text.index(" six"))
    spoilt = np.where(near, np.int32(262), ids)  # another id of other length shifts the places after it
    good = coder.repaired(raw, at, cuts, ids)[0]
    assert good.tolist() == library(coder, text)
    same_size = [i for i in range(len(ids)) if near[i]]
    for i in same_size:
        twins = np.flatnonzero(coder.size == coder.size[ids[i]])
        spoilt[i] = twins[0] if twins[0] != ids[i] else twins[1]
    assert coder.repaired(raw, at, cuts, spoilt)[0].tolist() == library(coder, text)


def test_chunks_follow_the_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 8000, dtype=np.uint8)
    a = np.concatenate([rng.integers(97, 123, 777, dtype=np.uint8), shared])
    b = np.concatenate([rng.integers(97, 123, 31, dtype=np.uint8), shared])
    chunks = [{x[i:j].tobytes() for i, j in zip(c, c[1:], strict=False)} for x in (a, b) for c in [chunked_bpe.rolling_cuts(x, np.array([0, len(x)]))]]
    assert len(chunks[0] & chunks[1]) >= 8


def test_chunks_are_encoded_once(coder):
    text = " ".join(f"word{i}" for i in range(2000))
    encoded(coder, [text])
    fresh = coder.fresh_chunks
    assert encoded(coder, ["intro " + text])[0] == library(coder, "intro " + text)
    assert fresh > 10 and coder.fresh_chunks <= fresh + 2


def test_small_memory_changes_nothing():
    coder = chunked_bpe.ChunkedBpe(PATH, most=500)
    rows = [" ".join(f"w{i * k}" for i in range(50)) for k in range(20)]
    assert [encoded(coder, [r])[0] for r in rows] == [library(coder, r) for r in rows]


def test_long_texts_in_parts(monkeypatch, coder):
    monkeypatch.setattr(chunked_bpe, "PART", 100)
    for text in ("ab cd 'll\n" * 300, "é" * 2000, "x " * 50 + "y" * 500):
        ids = coder.encode_long(np.frombuffer(text.encode(), np.uint8))
        assert ids.tolist() == library(coder, text)
        assert coder.vocabulary.decode(ids).tobytes().decode() == text


def test_colliding_hashes_stay_apart(monkeypatch, coder):
    monkeypatch.setattr(chunked_bpe, "hash_spans", lambda raw, a, b: np.zeros(len(a), np.uint64))
    text = "many different words of one hash, and longer ones: incomprehensibilities"
    assert encoded(coder, [text])[0] == library(coder, text)


def test_query(spark, coder):
    got = {r.doc_id: r for r in queries.op11_chunked_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids, own = library(coder, row.text), got[row.doc_id]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = coder.tokenizer.decode(ids, skip_special_tokens=False)
        assert decoded == row.text and own.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, 1, "x"), (None, "a b", 1, "x"), (2, "", 2, "x"), (2, "", 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    out = chunked_bpe.decode(chunked_bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == [(0, "a b"), (1, ""), (2, ""), (2, "")]
    assert chunked_bpe.decode(chunked_bpe.encode(docs.limit(0), PATH), PATH).collect() == []
