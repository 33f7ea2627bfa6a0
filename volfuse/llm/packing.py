"""Packing of token sequences by reciprocal-capacity classes.

A document's tokens beyond whole sequences belong to class j when j of them fit into a sequence but j + 1
may not: lengths in (C/(j+1), C/j]. A sequence of class j takes exactly j documents and is then closed;
what is left of it is filled by cutting short documents, or the next one of any length when more than
``waiting`` closed sequences wait. Every task packs its own documents, so nothing is shuffled. What a task
holds in the end is cut into whole sequences and, for the last tokens, into sequences whose length is a
power of two, which need no padding.

Null texts are empty and consist of the end token alone. Equal documents are packed each for itself.
"""

from __future__ import annotations

import os
import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from volfuse.llm.texts import LOWER, Runs, hash_spans, per_text, pieces, ragged, text_bytes, words

OTHER, LETTER, DIGIT, BLANK, WHOLE = range(5)

#: Tasks number their sequences apart from each other; a task has fewer than 2**32.
_TASK = 1 << 32
#: The kind of the characters below U+0100; both bytes of one from U+0080 on get it.
_KIND = np.array(
    [BLANK if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else LETTER if c.isalpha() else DIGIT if unicodedata.category(c)[0] == "N" else OTHER for c in map(chr, range(256))],
    np.uint8,
)
SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordIds:
    """Token ids of texts for a tokenizer that lower-cases, drops blanks and merges letters, digits and other
    characters apart: each different run of one kind is encoded once.

    Words with characters from U+0100 on are encoded whole, as composing and lower-casing may join or split them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Runs()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def units(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and kind of the spans that are encoded apart; kind 1: one pre-token for certain."""
        first, last, _ = words(raw, at)
        kind = _KIND[raw]
        lead = np.flatnonzero((raw & 0xFE) == 0xC2)
        kind[lead] = kind[lead + 1] = _KIND[((raw[lead] & 3) << 6) | (raw[lead + 1] & 0x3F)]
        # Words that are kept whole: those with other multi-byte characters or the beginning of a special token.
        odd = raw > 0xC3
        data = raw.tobytes()
        for token in self.specials:
            p = data.find(token)
            while p >= 0:
                odd[p] = True
                p = data.find(token, p + 1)
        whole = per_text(odd, np.append(first, len(raw)))[: len(first)] > 0 if len(first) else np.zeros(0, bool)
        mark = np.zeros(len(raw) + 1, np.int8)
        mark[first[whole]] += 1
        mark[last[whole]] -= 1
        kind[np.cumsum(mark[:-1], dtype=np.int8) > 0] = WHOLE
        new = np.ones(len(raw), bool)
        new[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == DIGIT) & ((raw[1:] & 0xC0) != 0x80))
        new[at[:-1][at[:-1] < len(raw)]] = True
        # A lone apostrophe goes with the letters after it: the tokenizer itself finds contractions.
        lone = np.flatnonzero(new[:-1] & (raw[:-1] == 0x27) & new[1:] & (kind[1:] == LETTER) & (kind[:-1] == OTHER))
        lone = lone[~np.isin(lone + 1, at)]
        new[lone + 1] = False
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(raw))
        keep = kind[starts] != BLANK
        sure = (kind[starts] != WHOLE) & (raw[starts] != 0x27)
        return starts[keep], ends[keep], sure[keep]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the bounds of each text's."""
        raw, at = text_bytes(column)
        raw = LOWER[raw] if len(raw) else raw
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        first, last, sure = self.units(raw, at)
        text = np.searchsorted(at, first, "right") - 1
        data = raw.tobytes()

        def learn(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            spans = zip(first[new].tolist(), last[new].tolist(), strict=True)
            forms = [data[a:b].decode("utf-8", "replace") for a, b in spans]
            plain, rest = np.flatnonzero(sure[new]), np.flatnonzero(~sure[new])
            where, length, pool, held = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [], 0
            for k in range(0, len(plain), 256):
                own = plain[k : k + 256]
                ids = self.tokenizer.encode(" ".join([forms[i] for i in own]), add_special_tokens=False).ids
                ids = np.array(ids, np.int32)
                cut = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])
                if len(cut) != len(own) + 1:
                    rest = np.concatenate([rest, own])
                    continue
                where[own], length[own] = held + cut[:-1], np.diff(cut)
                pool.append(ids)
                held += len(ids)
            for i in rest.tolist():
                ids = np.array(self.tokenizer.encode(forms[i], add_special_tokens=False).ids, np.int32)
                where[i], length[i] = held, len(ids)
                pool.append(ids)
                held += len(ids)
            return length, np.concatenate([np.zeros(0, np.int32), *pool])[ragged(where, length)]

        row = self.known.look_up(hash_spans(raw, first, last), learn)
        length = self.known.length[row]
        count = np.bincount(text, length, len(column)).astype(np.int64)
        return self.known.ids[ragged(self.known.start[row], length)], np.concatenate([[0], np.cumsum(count)])


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """Sequences of one task: lists of (doc_id, start, ids, doc_tokens), given out when they are full."""

    def __init__(self, capacity: int = 4096, classes: int = 64, waiting: int = 4):
        self.capacity, self.classes, self.waiting = capacity, classes, waiting
        self.open: dict[int, list] = {}
        self.gaps: deque[tuple[list, int]] = deque()

    def class_of(self, length: int) -> int:
        j = self.capacity // length
        return j if j <= self.classes else 1 << (j.bit_length() - 1)

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[list]:
        total = len(ids)
        at = total - total % self.capacity
        for k in range(0, at, self.capacity):
            yield [(doc_id, k, ids[k : k + self.capacity], total)]
        short = at < total and self.capacity // (total - at) > self.classes
        while at < total and self.gaps and (short or len(self.gaps) > self.waiting):
            held, room = self.gaps.popleft()
            take = min(room, total - at)
            held.append((doc_id, at, ids[at : at + take], total))
            at += take
            if take == room:
                yield held
            else:
                self.gaps.appendleft((held, room - take))
        if at < total:
            j = self.class_of(total - at)
            held = self.open.setdefault(j, [])
            held.append((doc_id, at, ids[at:].copy(), total))
            if len(held) == j:
                del self.open[j]
                room = self.capacity - sum(len(x[2]) for x in held)
                if room:
                    self.gaps.append((held, room))
                else:
                    yield held

    def finish(self) -> Iterator[list]:
        rest = [x for held in [*(h for h, _ in self.gaps), *self.open.values()] for x in held]
        left = sum(len(x[2]) for x in rest)
        room = lambda: min(self.capacity, 1 << (left.bit_length() - 1))
        held, free = [], room() if left else 0
        for doc_id, start, ids, total in rest:
            at = 0
            while at < len(ids):
                take = min(free, len(ids) - at)
                held.append((doc_id, start + at, ids[at : at + take], total))
                at, free, left = at + take, free - take, left - take
                if not free:
                    yield held
                    held, free = [], room() if left else 0


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, classes: int = 64, waiting: int = 4
) -> DataFrame:
    """Pieces of the documents' token ids by sequence; ``ids`` are little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = word_ids(tokenizer), Packer(capacity, classes, waiting)
        number = TaskContext.get().partitionId() * _TASK
        rows: list[tuple] = []

        def take(sequence: list) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, ids, total in sequence:
                rows.append((doc_id, start, len(ids), ids.tobytes(), total, number, offset))
                offset += len(ids)
            number += 1

        def out() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            rows.clear()
            return batch

        for batch in batches:
            for part in pieces(batch):
                ids, at = coder.encode(part.column("text"))
                for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4")
                    for sequence in packer.add(doc_id, own):
                        take(sequence)
                if rows:
                    yield out()
        for sequence in packer.finish():
            take(sequence)
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
