"""Quality rules: counts of a text, and a calibrated classifier on hashed n-grams.

The counts take words as runs of other characters than blank and the controls 9 to 13. The classifier sees
the shares of hashed words, word pairs and four-byte windows in a text; it is fitted on a bounded sample of
labelled rows, calibrated on rows it wasn't fitted on, and scores Arrow batches against a fixed threshold.

Null and empty texts have no words, fail the base rule and score by the intercept. Without labels of both
kinds there is no model: the score is 1 and the base rule alone decides. Rows without an id can be scored
but never take part in fitting; an id labelled twice counts once for each label.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volfuse.llm.models import fit_dense, fit_sparse, margins, sigmoid
from volfuse.llm.texts import SPACE, U64, filtered, hash_spans, mix, per_text, pieces, share, text_bytes, windows, words

#: Symbols that count as junk; fixed by the rule.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
BITS = 16
SIZE = 3 << BITS
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def probability(self, z: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * z + self.shift)


def dup_lines(raw: np.ndarray, at: np.ndarray, solid: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier one of their text. Only lines of equal length are compared."""
    cut = np.flatnonzero(raw == 0x0A)
    starts = np.union1d(at[:-1], cut + 1)
    starts = starts[starts < len(raw)]
    if not len(starts):
        return np.zeros(len(at) - 1, np.int64)
    ends = np.append(starts[1:], len(raw))
    ends -= (raw[ends - 1] == 0x0A) & (ends > starts)
    full = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    keep = full[ends] > full[starts]
    starts, ends = starts[keep], ends[keep]
    text = np.searchsorted(at, starts, "right") - 1
    length = ends - starts
    order = np.lexsort((length, text))
    same = (text[order][1:] == text[order][:-1]) & (length[order][1:] == length[order][:-1])
    some = np.zeros(len(order), bool)
    some[order[1:][same]] = some[order[:-1][same]] = True
    picked = np.flatnonzero(some)
    data, seen, out = raw.tobytes(), set(), np.zeros(len(at) - 1, np.int64)
    for t, a, b in zip(text[picked].tolist(), starts[picked].tolist(), ends[picked].tolist(), strict=True):
        line = (t, data[a:b])
        out[t] += line in seen
        seen.add(line)
    return out


def repeat_words(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Words of a text in windows of three words that it has twice or more."""
    key, first = windows(hashes, text, 3)
    key = mix(key + text[first].astype(U64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(len(hashes), bool)
    for j in range(3):
        inside[first[twice] + j] = True
    return np.bincount(text[inside], minlength=texts)


def grams(raw: np.ndarray, at: np.ndarray, hashes: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and feature of every word, word pair and four-byte window, kind by kind."""
    low = U64((1 << BITS) - 1)
    yield text, (hashes & low).astype(np.int64)
    pair, first = windows(hashes, text, 2)
    yield text[first], (pair & low).astype(np.int64) + (1 << BITS)
    if len(raw) < 4:
        return
    inside = np.ones(len(raw) + 1, bool)
    for j in (1, 2, 3):
        inside[np.maximum(at[1:] - j, 0)] = False
    start = np.flatnonzero(inside[: len(raw) - 3])
    four = np.ndarray((len(raw) - 3,), "<u4", np.ascontiguousarray(raw), strides=(1,))[start]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[start]
    yield owner, ((four * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) + (2 << BITS)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled texts: a list of feature numbers and one of shares for each text."""
    for batch in batches:
        for part in pieces(batch):
            raw, at = text_bytes(part.column("text"))
            first, last, text = words(raw, at)
            hashes = hash_spans(raw, first, last)
            rows, features, shares = [], [], []
            for owner, feature in grams(raw, at, hashes, text):
                total = np.maximum(1, np.bincount(owner, minlength=part.num_rows))
                key, count = np.unique(owner * SIZE + feature, return_counts=True)
                rows.append(key // SIZE)
                features.append(key % SIZE)
                shares.append(count / total[key // SIZE])
            row = np.concatenate([np.zeros(0, np.int64), *rows])
            order = np.argsort(row, kind="stable")
            bounds = pa.array(np.searchsorted(row[order], np.arange(part.num_rows + 1)), pa.int32())
            lists = [
                pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.zeros(0), *x])[order], kind))
                for x, kind in ((features, pa.int32()), (shares, pa.float32()))
            ]
            yield pa.record_batch([part.column("doc_id"), part.column("y"), *lists], ["doc_id", "y", "feature", "share"])


def both_labels(known: DataFrame, rows: int) -> tuple[DataFrame, dict[int, float]]:
    """About ``rows`` labelled rows at most, of either label half or all that there are, and how many rows of its
    label each of them stands for."""
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    bad, good = total.get(0, 0), total.get(1, 0)
    quota = {1: min(good, max(rows // 2, rows - bad))}
    quota[0] = min(bad, rows - quota[1])
    rate = {k: quota[k] / max(1, total.get(k, 0)) for k in (0, 1)}
    sample = known.where(share(F.col("doc_id")) < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]))
    return sample, {k: 1 / r if r else 1.0 for k, r in rate.items()}


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, held: float = 0.25) -> Model | None:
    """A model from about ``rows`` labelled documents at most, ``held`` of them for the calibration.

    Either label gives half of the rows if it has as many. In the calibration each row stands for as many as its label
    has for one drawn, so that a score means the same for tables of any size.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y"))
    sample, stands_for = both_labels(known, rows)
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    found = joined.mapInArrow(_features, "doc_id bigint, y int, feature array<int>, share array<float>")
    found = found.withColumn("aside", share(F.col("doc_id"), 5) < held).orderBy("aside", "doc_id", "y")
    table = found.select("aside", "y", "feature", "share").toArrow()
    if not table.num_rows:
        return None
    y, aside = table.column("y").to_numpy().astype(float), table.column("aside").to_numpy().astype(bool)
    if y.min() == y.max():
        return None
    size = np.concatenate([np.diff(c.offsets.to_numpy()) for c in table.column("feature").chunks])
    bounds = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    feature, value = (np.concatenate([c.flatten().to_numpy() for c in table.column(n).chunks]) for n in ("feature", "share"))
    del table
    learn = int((~aside).sum())
    if len(set(y[:learn])) < 2 or len(set(y[learn:])) < 2:
        learn = len(y)
    weights, intercept = fit_sparse(bounds[: learn + 1], feature, value, y[:learn], SIZE)
    z = margins(bounds, feature, value, weights) + intercept
    check = slice(learn, None) if learn < len(y) else slice(None)
    times = np.where(y > 0, stands_for[1], stands_for[0])
    slope, shift = fit_dense(z[check][:, None], y[check], weight=times[check])
    return Model(weights.astype(np.float32), intercept, float(slope[0]), shift)


def measured(column: pa.Array, model: Model | None) -> tuple[list[np.ndarray], np.ndarray]:
    """The counts of every text and its probability of quality."""
    raw, at = text_bytes(column)
    first, last, text = words(raw, at)
    hashes = hash_spans(raw, first, last)
    solid = ~SPACE[raw]
    n = len(column)
    counts = [
        np.bincount(text, minlength=n),
        per_text(solid & ((raw & 0xC0) != 0x80), at),
        per_text(_SYMBOL[raw], at),
        dup_lines(raw, at, solid),
        repeat_words(hashes, text, n),
    ]
    if model is None:
        return counts, np.ones(n)
    z = np.full(n, model.intercept)
    for owner, feature in grams(raw, at, hashes, text):
        total = np.maximum(1, np.bincount(owner, minlength=n))
        z += np.bincount(owner, model.weights[feature], n) / total
    return counts, model.probability(z)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.5, min_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Per document: id, counts, ``base_failed``, the score (probability of quality) and ``kept``."""
    box = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                counts, p = measured(part.column("text"), box.value)
                columns = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(p)]
                yield pa.record_batch(columns, ["doc_id", *COUNTS, "score"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def accepted(docs: DataFrame, model: Model | None, threshold: float = 0.5, min_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """The rows that ``score`` keeps, with all their columns; rows without an id or with a shared one are judged alike."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    def keep(column: pa.Array) -> np.ndarray:
        counts, p = measured(column, box.value)
        n_words, repeated = counts[0], counts[-1]
        return (n_words >= min_words) & (100 * repeated <= most_repeated * n_words) & (p >= threshold)

    return filtered(docs, keep)
