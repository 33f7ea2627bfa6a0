"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from volfuse.llm import bpe, queries

PATH = public_tokenizers.path(queries.BYTE_RANKS)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(rows):
    ids, at = bpe.vocabulary(PATH).encode(pa.array(rows, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


PART = st.sampled_from(["'", "'s", "'ll", "'re", "s", "t", " ", "  ", "\n", "\t", "\xa0", "!", "1", "²", "é", "é", "漢", "😀", "Straße", "<|endoftext|>"])


@settings(deadline=None, max_examples=300)
@given(st.lists(st.lists(PART, max_size=12).map("".join), max_size=6))
def test_equals_library(library, rows):
    got = encoded([*rows, None])
    assert got == [library.encode_ordinary(s) for s in rows] + [[]]
    assert [bpe.vocabulary(PATH).decode(x).decode() for x in got] == [*rows, ""]


def test_every_character(library):
    text = "".join(f"x{c}x {c} 1{c}{c}'s" for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))
    assert encoded([text])[0] == library.encode_ordinary(text)


def test_long_word(library):
    text = "ab" * 20_000 + " " + "é" * 5_000
    assert encoded([text])[0] == library.encode_ordinary(text)


def test_perfect_hash():
    import numpy as np

    from volfuse.llm.texts import mix

    keys = mix(np.arange(5000, dtype=np.uint64))
    assert sorted(bpe.PerfectHash(keys).slot(keys).tolist()) == list(range(5000))


def test_query(spark, library):
    got = {r.doc_id: r for r in queries.op3_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids, own = library.encode_ordinary(row.text), got[row.doc_id]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, 1, "x"), (None, "a b", 1, "x"), (2, "", 2, "x"), (2, "", 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in out) == [(0, b"a b"), (1, b""), (2, b""), (2, b"")]
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).collect() == []
