"""Byte-level BPE by a rank file, encoding and decoding.

Pre-tokens are found on whole arrays of code points by their Unicode class. Whole pre-tokens that are in
the vocabulary are resolved by a minimal perfect hash: a slot
for every token, and a check of the 64-bit hash and the length. The rest are merged with a heap over linked bytes, lowest rank
first and leftmost among equals.

A null text is empty and has no ids. Ids not in the vocabulary raise KeyError on decoding.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volfuse.llm.texts import Runs, hash_spans, mix, pieces, ragged, text_bytes

OTHER, LETTER, NUMBER, BLANK = range(4)
#: Endings that follow an apostrophe as a token of their own; fixed by the pattern of the vocabulary.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the library whose results are to be met."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(probe.encode_ordinary(every)).decode("utf-8")
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def token_starts(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts begin, given their code points and the bounds of each text."""
    n = len(codes)
    kind = classes()[codes]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
    run_end = np.ones(n, bool)
    run_end[:-1] = new[1:]
    start = new.copy()
    # The last of several blanks before a word is a token of its own, or the word's if it is U+0020.
    last = run_end & (kind == BLANK) & ~edge[1:]
    start[last] = True
    glued = last & (codes == 0x20)
    start[1:][glued[:-1]] = False
    # An apostrophe that begins a token, stands alone, and is followed by one of the endings.
    mark = np.flatnonzero(start & run_end & (codes == 0x27) & ~edge[1:])
    long = np.concatenate([codes, np.zeros(2, codes.dtype)])
    end_of = at[np.searchsorted(at, mark, "right")] if len(mark) else mark
    for ending in CONTRACTIONS:
        fits = mark + len(ending) < end_of
        for j, c in enumerate(ending, 1):
            fits &= long[mark + j] == ord(c)
        p = mark[fits]
        start[p + 1] = False
        stop = p + 1 + len(ending)
        stop = stop[stop < n]
        start[stop[(kind[stop] == LETTER) | start[stop]]] = True
    return np.flatnonzero(start)


class PerfectHash:
    """Slots 0..n-1 for n different 64-bit keys: keys alone at their place in a bit field settle there, the others
    go on to the next, smaller field; a key's slot is the number of settled places before its own."""

    def __init__(self, keys: np.ndarray, room: int = 2):
        self.fields: list[tuple[np.ndarray, np.ndarray]] = []
        settled, rest = 0, keys
        while len(rest):
            place = self._place(rest, len(self.fields), room * len(rest))
            count = np.bincount(place, minlength=room * len(rest))
            alone = count == 1
            self.fields.append((alone, settled + np.cumsum(alone) - alone))
            settled += int(alone.sum())
            rest = rest[count[place] > 1]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ np.uint64((level + 1) * 0x632BE59BD9B4E019 % 2**64)) % np.uint64(size)).astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; any slot for keys not in the set."""
        out, rows = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.fields):
            place = self._place(keys[rows], level, len(alone))
            hit = alone[place]
            out[rows[hit]] = rank[place[hit]]
            rows = rows[~hit]
        return out


class Bpe:
    """A vocabulary, and the merged pre-tokens it remembers."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        tokens = list(self.ranks)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum([len(t) for t in tokens])
        keys = hash_spans(data, ends - [len(t) for t in tokens], ends)
        self.hash = PerfectHash(keys)
        slot = self.hash.slot(keys)
        self.key, self.id, self.size = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        self.key[slot], self.id[slot], self.size[slot] = keys, list(self.ranks.values()), [len(t) for t in tokens]
        self.merged = Runs()

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token. A heap entry is a number: rank, start of the left part, end of the right one."""
        n, get = len(word), self.ranks.get
        bits = n.bit_length()
        mask, push, pop = (1 << bits) - 1, heapq.heappush, heapq.heappop
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [((r << bits | i) << bits) | i + 2 for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            stop, i = entry & mask, entry >> bits & mask
            j = end[i]
            # A pair is current if its left part still begins there and its right part still ends there.
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                r = get(word[i : end[stop]])
                if r is not None:
                    push(heap, ((r << bits | i) << bits) | end[stop])
            p = before[i]
            if p >= 0:
                r = get(word[p:stop])
                if r is not None:
                    push(heap, ((r << bits | p) << bits) | stop)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return ids

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the bounds of each text's."""
        raw, at = text_bytes(column)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        data = raw.tobytes()
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = place[token_starts(codes, np.searchsorted(place, at))]
        ends = np.append(starts[1:], len(raw))
        text = np.searchsorted(at, starts, "right") - 1
        keys = hash_spans(raw, starts, ends)
        slot = self.hash.slot(keys)
        whole = (self.key[slot] == keys) & (self.size[slot] == ends - starts)
        rest = np.flatnonzero(~whole)

        def learn(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            spans = zip(starts[rest[new]].tolist(), ends[rest[new]].tolist(), strict=True)
            ids = [self.merge(data[a:b]) for a, b in spans]
            return np.array([len(x) for x in ids], np.int64), np.fromiter(chain.from_iterable(ids), np.int32)

        length, source = np.ones(len(starts), np.int64), np.arange(len(starts))
        row = self.merged.look_up(keys[rest], learn)
        length[rest], source[rest] = self.merged.length[row], len(starts) + self.merged.start[row]
        # Pre-tokens of one id read it from the first part of the pool, the others from the second.
        pool = np.concatenate([self.id[slot].astype(np.int32), self.merged.ids])
        count = np.bincount(text, length, len(column)).astype(np.int64)
        return pool[ragged(source, length)], np.concatenate([[0], np.cumsum(count)])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [*batch.schema.names, name]
    return pa.RecordBatch.from_arrays([*batch.columns, column], names)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and its ids, an array of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in batches:
            for part in pieces(batch):
                ids, at = coder.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([part.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [coder.decode(x or []) for x in part.column("ids").to_pylist()]
                yield _with(part.select(["doc_id", "ids"]), "decoded", pa.array(texts, pa.binary()))

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")
