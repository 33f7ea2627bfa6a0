"""Words, spans and hashes of Arrow text columns, computed on whole byte buffers.

Texts are UTF-8; a word is a run of bytes other than blank and the controls 9 to 13, so cutting a text
at word bounds never cuts a character. A null text is an empty one here. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_M1, _M2, _SEED = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0x2545F4914F6CDD1D)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], U64)
#: Multipliers of the words in a window; any odd numbers do.
_ODD = (np.arange(1, 129, dtype=U64) * _M1) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit; changes and returns ``x``."""
    x ^= x >> U64(32)
    x *= _M2
    x ^= x >> U64(29)
    x *= _M1
    x ^= x >> U64(32)
    return x


def pieces(batch: pa.RecordBatch, column: str | int = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of some ``limit`` text bytes; a longer text is whole in its slice."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the bounds of each."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if bounds is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(raw: np.ndarray, at: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; ``solid`` marks the bytes of words, if other than usual."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[raw] if solid is None else solid
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, eight bytes a step."""
    eight = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    left = (ends - starts).astype(np.int64)
    out = mix(left.astype(U64) + _SEED)
    rows, pos = np.arange(len(starts)), np.asarray(starts)
    while len(rows):
        chunk = eight[pos]
        chunk &= _MASK[np.minimum(left, 8)]
        chunk ^= out[rows]
        out[rows] = mix(chunk)
        more = left > 8
        rows, pos, left = rows[more], pos[more] + 8, left[more] - 8
    return out


def windows(hashes: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every ``size`` neighbours of one group, and the place of the first."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    for j in range(size):
        total += hashes[j : j + n] * _ODD[j]
    first = np.flatnonzero(group[:n] == group[size - 1 :])
    return mix(total[first]), first


def long_windows(hashes: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``windows``, at a cost that grows with the logarithm of ``size``."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    power, span, total, covered = mix(hashes.copy()), 1, None, 0
    rest = size
    while rest:
        if rest & 1:
            if total is None:
                total = power[: n - size + 1].copy()
            else:
                total = mix(total * U64(3) + power[covered : covered + n - size + 1])
            covered += span
        rest >>= 1
        if rest:
            power = mix(power[: len(power) - span] * U64(3) + power[span:])
            span *= 2
    first = np.flatnonzero(group[: n - size + 1] == group[size - 1 :])
    return total[first], first


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between the bounds of each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of the given runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Runs:
    """Runs of token ids by 64-bit key, remembered between batches.

    ``most`` bounds the keys held; beyond it the memory starts anew, which changes no result.
    """

    def __init__(self, most: int = 600_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, U64), np.zeros(0, np.int64)
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of every key, -1 if it isn't known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def add(self, keys: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        """New keys, in rising order, and their runs, one after the other."""
        rows = len(self.start) + np.arange(len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        self.length, self.ids = np.concatenate([self.length, length]), np.concatenate([self.ids, ids])

    def look_up(self, keys: np.ndarray, learn) -> np.ndarray:
        """The row of every key; ``learn`` gets the places of keys met for the first time, in order of the key,
        and returns the lengths and the ids of their runs."""
        own, one, same = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(own) > self.most:
            self.clear()
        row = self.find(own)
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = len(self.start) + np.arange(len(new))
            self.add(own[new], *learn(one[new]))
        return row[same]


def bounded_sample(df: DataFrame, key: str, rows: int, salt: int = 0) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of ``key``: the same rows in every run."""
    return df.where(share(F.col(key), salt) < rows / max(rows, df.count()))


def share(key: Column, salt: int = 0) -> Column:
    """A number from 0 to 1, in steps of 2**-52, that depends on ``key`` alone."""
    h = F.xxhash64(key.cast("string"), F.lit(salt))
    return F.pmod(h, F.lit(1 << 20)) / float(1 << 20) + F.pmod(F.shiftright(h, 20), F.lit(1 << 32)) / float(1 << 52)


def filtered(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows whose text ``keep`` accepts. Each row is judged for itself, whatever its id, and keeps all its columns,
    whatever their names; nothing is shuffled, and only the texts and the verdicts pass between Spark and Python."""

    @F.arrow_udf("boolean")
    def verdict(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        found = [np.asarray(keep(part.column(0)), bool) for part in pieces(batch)]
        return pa.array(np.concatenate([np.zeros(0, bool), *found]), pa.bool_())

    return docs.where(verdict(F.col("text").cast("string")))


def numbered(df: DataFrame) -> DataFrame:
    """The columns by number: names with dots can't be handed to Python."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
