"""Token ids against the tokenizers library, and the packing's invariants."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from volfuse.llm import packing, queries

PATH = public_tokenizers.path(queries.WORD_TOKENIZER)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


PART = st.sampled_from(["'", "'s", "'S", "'ll", "LL", "s", " ", "\n", "\xa0", "\x85", "!", "***", "12", "²", "é", "É", "é", "́", "İ", "Σ", "œ", "漢", "😀", "ª", "<|endoftext|>", "<|"])


@settings(deadline=None, max_examples=300)
@given(st.lists(st.lists(PART, max_size=12).map("".join), max_size=6))
def test_ids_equal_library(library, rows):
    ids, at = packing.word_ids(PATH).encode(pa.array([*rows, None], pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    assert got == [library.encode(s, add_special_tokens=False).ids for s in rows] + [[]]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 200), max_size=80), st.sampled_from([16, 64]))
def test_packer(lengths, capacity):
    packer = packing.Packer(capacity, classes=8, waiting=2)
    out = [s for k, n in enumerate(lengths) for s in packer.add(k, np.arange(n))]
    full = len(out)
    out += packer.finish()
    assert all(sum(len(x[2]) for x in s) == capacity for s in out[:full])
    sizes = [sum(len(x[2]) for x in s) for s in out]
    assert all(n & (n - 1) == 0 and n <= capacity for n in sizes)
    again = defaultdict(list)
    for s in out:
        for k, start, ids, total in s:
            assert total == lengths[k] and len(ids)
            assert ids.tolist() == list(range(start, start + len(ids)))
            again[k].append((start, len(ids)))
    for k, n in enumerate(lengths):
        ends = 0
        for start, size in sorted(again[k]):
            assert start == ends
            ends += size
        assert ends == n


def test_class_takes_a_fixed_count():
    packer = packing.Packer(100)
    out = [s for k in range(9) for s in packer.add(k, np.zeros(30, int))]
    assert out == [] and [len(h) for h, _ in packer.gaps] == [3, 3, 3] and not packer.open


def test_query(spark, library):
    rows = queries.op9_packing(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sequences = defaultdict(list)
    ids = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in docs.items()}
    seen = defaultdict(int)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen == {k: len(v) for k, v in ids.items()}
    padding = 0
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 4096
        padding += 0 if ends & (ends - 1) == 0 else 4096 - ends
    assert padding == 0


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (2, "", 7), (3, "a " * 9000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    out = packing.pack(docs, PATH).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in out if r.start == 0) == [(1, 1), (2, 1), (2, 1), (3, 9001)]
    assert packing.pack(docs.limit(0), PATH).collect() == []
