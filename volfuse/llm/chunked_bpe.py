"""Byte-level BPE by a tokenizer file, with content-defined chunks that are encoded once.

A rolling hash of the last 32 bytes cuts every text into chunks, so texts that share a passage share its chunks
wherever it stands. A worker remembers the ids of chunks, and chunks it has met before aren't encoded again. A cut
may fall inside a token. Therefore the text around each cut, from one certain bound to another and one unit further
on either side, is encoded again; the ids of the outer units must be those of the chunks, else the range grows until
they are or the text ends. A certain bound lies between a printable ASCII character and a blank or line feed: no
pre-token and no special token of the vocabulary goes over it, whatever stands on either side.

Chunks are compared by their bytes. New chunks are cut into pre-tokens, and each different pre-token is encoded
by the library itself, once. Both memories are bounded; beyond the bound they start anew, which
changes no result. Texts longer than a mebibyte are encoded in parts between certain bounds.

A null text is empty and has no ids. Rows that share an id stay apart; columns other than ``doc_id`` and ``text``
are left out. Decoding null ids gives an empty text; ids not in the vocabulary raise IndexError.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volfuse.llm.bpe import token_starts
from volfuse.llm.texts import hash_spans, mix, pieces, ragged, text_bytes

WINDOW = 32
#: A cut after each byte whose hash has so many leading zeros: every 512 bytes on average.
ZEROS = 9
LONGEST = 1 << 14
PART = 1 << 20
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters stand for
    themselves, the other bytes are numbered from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The different numbers of both, in order."""
    x = np.concatenate([a, b])
    x.sort(kind="stable")
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def rolling_cuts(raw: np.ndarray, at: np.ndarray, zeros: int = ZEROS, longest: int = LONGEST) -> np.ndarray:
    """Bounds of the chunks of texts, all bounds of texts among them. They depend on a text's own bytes only."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    place = np.flatnonzero(h >> np.uint32(32 - zeros) == 0) + 1
    start = at[np.searchsorted(at, place, "right") - 1]
    place = place[(place < len(raw)) & (place - start >= WINDOW)]
    cuts = union(at, place[(raw[place] & 0xC0) != 0x80])
    wide = np.flatnonzero(np.diff(cuts) > longest)
    if len(wide):
        more = np.concatenate([np.arange(cuts[i] + longest, cuts[i + 1], longest) for i in wide])
        while (inside := (raw[more] & 0xC0) == 0x80).any():
            more = more - inside
        cuts = union(cuts, more)
    return cuts


def certain_bounds(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a text can be cut without a change of its ids; all bounds of texts among them."""
    blank = (raw[1:] == 0x20) | (raw[1:] == 0x0A)
    return union(at, np.flatnonzero(blank & (raw[:-1] > 0x20) & (raw[:-1] < 0x7F)) + 1)


def same_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether spans of equal length at ``a`` and ``b`` hold the same bytes."""
    eight = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    out, rows, left = np.ones(len(a), bool), np.arange(len(a)), length.copy()
    while len(rows):
        cover = np.uint64(8) * np.minimum(left, 8).astype(np.uint64)
        mask = np.where(left >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (cover & np.uint64(63))) - np.uint64(1))
        out[rows] &= (eight[a[rows]] ^ eight[b[rows]]) & mask == 0
        more = left > 8
        rows, left = rows[more], left[more] - 8
        a, b = a.copy(), b.copy()
        a[rows] += 8
        b[rows] += 8
    return out


class Memory:
    """Runs of ids by bytes, in one array; beyond ``most`` bytes, some 120 for each key included, it starts anew."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.held = self.used = 0
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 12, np.int32)

    def look_up(self, keys: list[bytes], learn) -> tuple[np.ndarray, np.ndarray]:
        """First place in ``ids`` and length of every key's run; ``learn`` gets the unknown keys, each once, and
        returns the lengths and the ids of their runs."""
        if self.held > self.most:
            self.clear()
        new = list(dict.fromkeys(k for k in keys if k not in self.rows))
        if new:
            length, ids = learn(new)
            self.rows.update(zip(new, range(len(self.start), len(self.start) + len(new)), strict=True))
            self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.held += sum(map(len, new)) + 4 * len(ids) + 120 * len(new)
        row = np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))
        return self.start[row], self.length[row]


class Vocabulary:
    """The bytes of every id."""

    def __init__(self, tokenizer):
        letters, added = byte_letters(), {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
        names = tokenizer.get_vocab(with_added_tokens=False)
        tokens = [b""] * (1 + max([*names.values(), *added]))
        for token, i in names.items():
            tokens[i] = bytes(letters[c] for c in token)
        for i, token in added.items():
            tokens[i] = token.encode()
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.specials = [t.encode() for t in added.values()]
        self.feed = tokens.index(b"\n")

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.place[ids], self.size[ids])]


class ChunkedBpe:
    """A tokenizer, its chunks and its pre-tokens."""

    def __init__(self, path: str, most: int = 24 << 20):
        self.tokenizer = load(path)
        self.vocabulary = Vocabulary(self.tokenizer)
        self.size = self.vocabulary.size
        self.words, self.chunks = Memory(most), Memory(most)
        self.met_chunks = self.fresh_chunks = 0

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def learn(self, forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens. Those that don't end in a blank are encoded many at once, a line each."""
        texts = [f.decode() for f in forms]
        plain = [i for i, t in enumerate(texts) if not t[-1].isspace()]
        rest = [i for i, t in enumerate(texts) if t[-1].isspace()]
        where, length, pool, held = np.zeros(len(forms), np.int64), np.zeros(len(forms), np.int64), [], 0
        for k in range(0, len(plain), 256):
            own = plain[k : k + 256]
            ids = self.library("\n".join([texts[i] for i in own]))
            ends = np.append(np.flatnonzero(ids == self.vocabulary.feed), len(ids))
            if len(ends) != len(own):
                rest += own
                continue
            begin = np.concatenate([[0], ends[:-1] + 1])
            where[own], length[own] = held + begin, ends - begin
            pool.append(ids)
            held += len(ids)
        for i in rest:
            ids = self.library(texts[i])
            where[i], length[i] = held, len(ids)
            pool.append(ids)
            held += len(ids)
        return length, np.concatenate([np.zeros(0, np.int32), *pool])[ragged(where, length)]

    def whole(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that are encoded each for itself, and the bounds of each."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        data = raw.tobytes()
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        codes = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        starts = place[token_starts(codes, np.searchsorted(place, at))]
        ends = np.append(starts[1:], len(raw))
        size = ends - starts
        text = np.searchsorted(at, starts, "right") - 1
        # Spans of one hash and one content are one form; those of another content are forms of their own.
        _, one, row = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        twin = one[row]
        other = np.flatnonzero((size != size[twin]) | ~same_spans(raw, starts, starts[twin], np.minimum(size, size[twin])))
        one, row[other] = np.append(one, other), len(one) + np.arange(len(other))
        forms = [data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        begin, length = self.words.look_up(forms, self.learn)
        length = length[row]
        ids = self.words.ids[ragged(begin[row], length)]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(text, length, len(at) - 1).astype(np.int64))])
        special = {int(np.searchsorted(at, p, "right")) - 1 for s in self.vocabulary.specials for p in occurrences(data, s)}
        if special:
            parts = np.split(ids, bounds[1:-1])
            for k in special:
                parts[k] = self.library(data[at[k] : at[k + 1]].decode())
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds

    def fresh(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        self.fresh_chunks += len(chunks)
        at = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])
        ids, bounds = self.whole(np.frombuffer(b"".join(chunks), np.uint8), at)
        return np.diff(bounds), ids

    def from_chunks(self, raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The ids of the chunks between the cuts, one after the other."""
        data = raw.tobytes()
        keys = [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        self.met_chunks += len(keys)
        begin, length = self.chunks.look_up(keys, self.fresh)
        return self.chunks.ids[ragged(begin, length)]

    def repaired(self, raw: np.ndarray, at: np.ndarray, cuts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids after the joins of chunks were encoded again, and where each begins in ``raw``."""
        sure = certain_bounds(raw, at)
        start = np.cumsum(self.size[ids]) - self.size[ids]
        joins = cuts[sure[np.searchsorted(sure, cuts)] != cuts]
        if not len(joins):
            return ids, start
        text = np.searchsorted(at, joins, "right") - 1
        low, high = np.searchsorted(sure, at[text]), np.searchsorted(sure, at[text + 1])
        left = np.searchsorted(sure, joins, "right") - 1
        right, reach = left + 1, 1
        left, right = np.maximum(left - 1, low), np.minimum(right + 1, high)
        pool = [(ids, start)]
        while len(left):
            left, right, low, high = merged(left, right, low, high)
            spans = sure[right] - sure[left]
            part = ragged(sure[left], spans)
            got, bounds = self.whole(raw[part], np.concatenate([[0], np.cumsum(spans)]))
            size = self.size[got]
            where = part[np.cumsum(size) - size]
            owner = np.repeat(np.arange(len(left)), np.diff(bounds))
            outer = (left > low)[owner] & (where < sure[left + 1][owner]) | (right < high)[owner] & (where >= sure[right - 1][owner])
            twin = np.minimum(np.searchsorted(start, where), len(start) - 1)
            differs = np.bincount(owner, outer & ((start[twin] != where) | (ids[twin] != got)), len(left)) > 0
            keep = ~differs[owner]
            pool.append((got[keep], where[keep]))
            first, last = sure[left[~differs]], sure[right[~differs]]
            for k, (own, place) in enumerate(pool[:-1]):
                inside = np.searchsorted(first, place, "right") - 1
                out = (inside >= 0) & (place < last[inside]) if len(first) else np.zeros(len(place), bool)
                pool[k] = (own[~out], place[~out])
            reach *= 2
            left, right = np.maximum(left[differs] - reach, low[differs]), np.minimum(right[differs] + reach, high[differs])
            low, high = low[differs], high[differs]
        ids, start = (np.concatenate(x) for x in zip(*pool, strict=True))
        order = np.argsort(start, kind="stable")
        return ids[order], start[order]

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts in a row and the bounds of each text's."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        cuts = rolling_cuts(raw, at)
        ids, start = self.repaired(raw, at, cuts, self.from_chunks(raw, cuts))
        return ids, np.searchsorted(start, at)

    def encode_long(self, raw: np.ndarray) -> np.ndarray:
        """The ids of one text of any length, in parts between certain bounds."""
        sure = certain_bounds(raw, np.array([0, len(raw)]))
        ends = np.searchsorted(sure, np.arange(PART, len(raw), PART))
        cuts = np.unique(np.concatenate([[0], sure[ends], [len(raw)]]))
        parts = [self.encode(raw[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.concatenate([np.zeros(0, np.int32), *parts])


def merged(left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping ranges as one; a range's bounds are those of its text."""
    order = np.argsort(left, kind="stable")
    left, right, low, high = left[order], np.maximum.accumulate(right[order]), low[order], high[order]
    new = np.ones(len(left), bool)
    new[1:] = left[1:] >= right[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(left)) - 1
    return left[new], right[last], low[new], high[new]


def occurrences(data: bytes, part: bytes) -> Iterator[int]:
    at = data.find(part)
    while at >= 0:
        yield at
        at = data.find(part, at + 1)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkedBpe:
    return ChunkedBpe(path)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(load(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and its ids, an array of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for part in pieces(batch):
                raw, at = text_bytes(part.column("text"))
                if part.num_rows == 1 and len(raw) > PART:
                    ids = coder.encode_long(raw)
                    bounds = np.array([0, len(ids)])
                else:
                    ids, bounds = coder.encode(raw, at)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([part.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the text of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in part.column("ids")]
                texts = [coder.decode(x).tobytes().decode("utf-8", "replace") for x in ids]
                columns = [part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())]
                yield pa.record_batch(columns, ["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
