"""Spans and hashes of byte buffers against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from volfuse.llm import texts

TEXT = st.one_of(st.none(), st.text(st.sampled_from(list("ab Z\t\n\x0b é漢\xa0'.")), max_size=40))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(deadline=None, max_examples=200)
@given(st.lists(TEXT, max_size=12), st.integers(0, 3))
def test_words(rows, skip):
    column = pa.array(["x y", *rows], pa.string()).slice(min(skip, len(rows)))
    raw, at = texts.text_bytes(column)
    first, last, text = texts.words(raw, at)
    got = [(int(t), raw[a:b].tobytes().decode()) for a, b, t in zip(first, last, text, strict=True)]
    assert got == [(k, w) for k, s in enumerate(column.to_pylist()) for w in WORD.findall(s or "")]
    hashes = texts.hash_spans(raw, first, last)
    assert len(set(hashes.tolist())) == len({w for _, w in got})


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_windows(values, size):
    group = np.array([i // 25 for i in range(len(values))], np.int64)
    hashes = texts.mix(np.array(values, np.uint64) + np.uint64(9))
    for f in (texts.windows, texts.long_windows):
        got, place = f(hashes, group, size)
        want = [i for i in range(len(values) - size + 1) if group[i] == group[i + size - 1]]
        assert place.tolist() == want
        by = {}
        for h, i in zip(got.tolist(), want, strict=True):
            assert by.setdefault(tuple(values[i : i + size]), h) == h
        assert len(set(by.values())) == len(by)


def test_pieces_are_whole():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 50, "", "c"])], ["text"])
    parts = [p.column("text").to_pylist() for p in texts.pieces(batch, limit=20)]
    assert sum(parts, []) == batch.column("text").to_pylist() and len(parts) == 2
    assert not list(texts.pieces(batch.slice(0, 0)))


def test_runs_are_remembered():
    runs, seen = texts.Runs(most=4), []

    def learn(keys):
        def new(places):
            seen.extend(keys[places].tolist())
            return np.ones(len(places), np.int64), keys[places].astype(np.int32)

        return new

    for keys in ([5, 3, 5], [3, 9], [1, 2, 7, 8]):
        keys = np.array(keys, np.uint64)
        row = runs.look_up(keys, learn(keys))
        assert runs.ids[runs.start[row]].tolist() == keys.tolist()
    assert seen == [3, 5, 9, 1, 2, 7, 8]
