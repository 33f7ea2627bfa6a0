"""Toxic spans and scores by a linear-chain conditional random field.

Tokens are runs of letters (bytes from 128 on count as letters), lower-cased from A to Z. The chain has two
states, clean and toxic; a token's potential is a sum of weights of its hashed features (the whole token, its
first three to eight and last three bytes), and a matrix weighs the transitions. Labels are known for documents
only, so tokens are labelled first: features that cover toxic documents and hardly any clean ones are taken
greedily, the one that covers most of those not covered yet first, and tokens with such a feature in toxic
documents are toxic. The field is then fitted to these tokens by gradient steps on its likelihood.

Forward-backward marginals of all tokens of a batch are computed at once: a step of the chain is a matrix of
two by two, blocks of steps are multiplied side by side, and the first token of a text forgets what came
before. A document's score is a calibrated function of its marginals; its spans are the runs of tokens whose
marginal is at least 0.5, as offsets in characters.

Null and empty texts, and texts without letters, have no tokens: their score is that of a text whose
marginals are 0. Without labels of both kinds there is no model and every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volfuse.llm.models import fit_dense, sigmoid
from volfuse.llm.texts import LOWER, U64, hash_spans, mix, pieces, share, text_bytes, words

BITS = 18
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True
#: Lengths of the beginnings of a token that are features, beside the whole token and its last three bytes.
FIRST = (3, 4, 5, 6, 7, 8)
#: Features that may mark tokens as toxic.
MARKS = (0, 2, 3, 4, 5, 6)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of every token, and where it begins, ends and belongs."""
    raw, at = text_bytes(column)
    first, last, text = words(raw, at, LETTER[raw])
    raw, size = LOWER[raw], last - first
    spans = [(first, last), *((first, first + np.minimum(size, n)) for n in FIRST), (last - np.minimum(size, 3), last)]
    kinds = [hash_spans(raw, a, b) for a, b in spans]
    return np.column_stack([mix(h + U64(k)) & U64((1 << BITS) - 1) for k, h in enumerate(kinds)]).astype(np.int32), first, last, text


def chain(score: np.ndarray, begins: np.ndarray, start: np.ndarray, move: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward shares of the toxic state at every token; shares of both states add up to 1."""
    n = len(score)
    blocks = -(-n // width)
    up = np.exp(np.clip(score, -30, 30))
    step = np.empty((4, blocks * width))
    step[:, n:] = np.array([1.0, 0.0, 0.0, 1.0])[:, None]
    step[0, :n] = np.where(begins, start[0], move[0, 0])
    step[1, :n] = np.where(begins, start[1], move[0, 1]) * up
    step[2, :n] = np.where(begins, start[0], move[1, 0])
    step[3, :n] = np.where(begins, start[1], move[1, 1]) * up
    a, b, c, d = (x.reshape(blocks, width) for x in step)
    whole = np.array([[1.0], [0.0], [0.0], [1.0]]) * np.ones(blocks)
    for k in range(width):
        p, q, r, s = whole
        whole = np.array([p * a[:, k] + q * c[:, k], p * b[:, k] + q * d[:, k], r * a[:, k] + s * c[:, k], r * b[:, k] + s * d[:, k]])
        whole /= whole.max(axis=0)
    into, back = np.empty(blocks), np.empty(blocks)
    x = 0.5
    rows = whole.T.tolist()
    for i, (p, q, r, s) in enumerate(rows):
        into[i] = x
        u, v = (1 - x) * p + x * r, (1 - x) * q + x * s
        x = v / (u + v)
    x = 0.5
    for i in range(blocks - 1, -1, -1):
        back[i] = x
        p, q, r, s = rows[i]
        u, v = p * (1 - x) + q * x, r * (1 - x) + s * x
        x = v / (u + v)
    ahead, behind = np.empty((blocks, width)), np.empty((blocks, width))
    for k in range(width):
        u, v = (1 - into) * a[:, k] + into * c[:, k], (1 - into) * b[:, k] + into * d[:, k]
        ahead[:, k] = into = v / (u + v)
    for k in range(width - 1, -1, -1):
        behind[:, k] = back
        u, v = a[:, k] * (1 - back) + b[:, k] * back, c[:, k] * (1 - back) + d[:, k] * back
        back = v / (u + v)
    return ahead.ravel()[:n], behind.ravel()[:n]


def marginals(ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    yes, no = ahead * behind, (1 - ahead) * (1 - behind)
    return yes / (yes + no)


class Field(NamedTuple):
    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray
    slope: np.ndarray = np.zeros(3)
    shift: float = 0.0

    def tag(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The marginal of every token, and where it begins, ends and belongs."""
        features, first, last, text = tokens(column)
        if not len(text):
            return np.zeros(0), first, last, text
        score = np.zeros(len(text))
        for k in range(features.shape[1]):
            score += self.weights[features[:, k]]
        begins = np.ones(len(text), bool)
        begins[1:] = text[1:] != text[:-1]
        return marginals(*chain(score, begins, self.start, self.move)), first, last, text


def summary(p: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Of each text: the largest log-odds of a token, and the log-odds that any token is toxic, plain and on a log scale."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    top = np.full(texts, -8.0)
    np.maximum.at(top, text, np.log(p / (1 - p)))
    any_ = np.bincount(text, -np.log1p(-p), texts)
    return np.column_stack([np.clip(top, -8, 8), np.minimum(any_, 20), np.log1p(any_)])


def toxic_marks(features: np.ndarray, text: np.ndarray, y: np.ndarray, most_clean: float = 0.25) -> np.ndarray:
    """Features that cover toxic texts: the one first that covers most of those not covered yet, less the clean ones.

    A clean text counts by how much rarer the toxic ones are; a feature that covers more than the share
    ``most_clean`` of what it covers of the toxic ones is none.
    """
    pairs = np.unique(np.concatenate([features[:, k].astype(np.int64) * len(y) + text for k in MARKS]))
    feature, doc = pairs // len(y), pairs % len(y)
    own, col = np.unique(feature, return_inverse=True)
    clean = np.bincount(col, y[doc] == 0, len(own))
    toxic = np.bincount(col, y[doc] == 1, len(own))
    cost = clean * ((y == 1).sum() / max(1, (y == 0).sum()))
    odd = cost <= most_clean * toxic
    use = (odd & (toxic >= 2))[col] & (y[doc] == 1)
    col, doc = col[use], doc[use]
    taken, covered = [], np.zeros(len(y), bool)
    while len(col):
        gain = np.bincount(col[~covered[doc]], minlength=len(own)) - cost
        best = int(gain.argmax())
        if gain[best] < 1.5:
            break
        taken.append(own[best])
        covered[doc[col == best]] = True
    return np.array(taken, np.int64)


def train(
    features: np.ndarray, begins: np.ndarray, label: np.ndarray, times: np.ndarray, steps: int = 60, rate: float = 0.2, l2: float = 1e-6
) -> Field:
    """Weights and transitions that raise the likelihood of the labels, by Adam steps on all tokens; each counts ``times``."""
    size, n = 1 << BITS, times.sum()
    w, trans = np.zeros(size), np.zeros(6)  # transitions: two to start with, then 00, 01, 10, 11
    m, v = np.zeros(size + 6), np.zeros(size + 6)
    truth = label.astype(float)
    inner = np.flatnonzero(~begins)
    seen = np.bincount(label[inner - 1] * 2 + label[inner], times[inner], 4)
    seen_start = np.bincount(label[begins], times[begins], 2)
    for t in range(1, steps + 1):
        score = w[features].sum(axis=1)
        start, move = np.exp(trans[:2]), np.exp(trans[2:]).reshape(2, 2)
        ahead, behind = chain(score, begins, start, move)
        p = marginals(ahead, behind)
        error = times * (p - truth) / n
        g = np.zeros(size + 6)
        for k in range(features.shape[1]):
            g[:size] += np.bincount(features[:, k], error, size)
        g[:size] += l2 * w
        before, up, after = ahead[inner - 1], np.exp(np.clip(score[inner], -30, 30)), behind[inner]
        joint = np.array([(1 - before) * move[0, 0] * (1 - after), (1 - before) * move[0, 1] * up * after, before * move[1, 0] * (1 - after), before * move[1, 1] * up * after])
        g[size + 2 :] = ((joint / joint.sum(axis=0)) @ times[inner] - seen) / n
        g[size : size + 2] = (np.array([(1 - p[begins]) @ times[begins], p[begins] @ times[begins]]) - seen_start) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= change[:size]
        trans -= change[size:]
    return Field(w.astype(np.float32), np.exp(trans[:2]), np.exp(trans[2:]).reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, toxic_rows: int = 600, clean_rows: int = 1200) -> Field | None:
    """A field from labelled rows where ``learn`` holds, a bounded number of either kind.

    Each row drawn stands for as many as its kind has for one drawn, so that a score means the same for tables of any size.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("y"))
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    rate = {k: most / max(most, total.get(k, 0)) for k, most in ((0, clean_rows), (1, toxic_rows))}
    sample = known.where(share(F.col("doc_id")) < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]))
    drawn = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    table = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").toArrow()
    table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = table.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    column = table.column("text").combine_chunks()
    features, _, _, text = tokens(column)
    marks = toxic_marks(features, text, y)
    label = np.zeros(len(text), np.int64)
    for k in MARKS:
        label |= np.isin(features[:, k], marks) & (y[text] == 1)
    if not label.any():
        return None
    begins = np.ones(len(text), bool)
    begins[1:] = text[1:] != text[:-1]
    times = np.where(y == 1, total[1] / drawn[1], total[0] / drawn[0])
    field = train(features, begins, label, times[text])
    # Scores are calibrated on the same documents, by how often each kind occurs among all labels.
    p, _, _, text = field.tag(column)
    x = summary(p, text, len(y))
    slope, shift = fit_dense(x, y.astype(float), weight=times)
    return field._replace(slope=slope, shift=shift)


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """Per document: id, score, and the toxic spans as offsets in characters."""
    box = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = box.value
        for batch in batches:
            for part in pieces(batch):
                n, column = part.num_rows, part.column("text")
                if fitted is None:
                    empty = pa.array([[]] * n, pa.list_(span))
                    yield pa.record_batch([part.column("doc_id"), pa.array(np.zeros(n)), empty], ["doc_id", "score", "spans"])
                    continue
                p, first, last, text = fitted.tag(column)
                z = summary(p, text, n) @ fitted.slope + fitted.shift
                yield pa.record_batch([part.column("doc_id"), pa.array(sigmoid(z)), spans(column, p, first, last, text, span)], ["doc_id", "score", "spans"])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return out.mapInArrow(run, "doc_id bigint, score double, spans array<struct<start: bigint, end: bigint>>")


def spans(column: pa.Array, p: np.ndarray, first: np.ndarray, last: np.ndarray, text: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Runs of toxic tokens of one text, as offsets in its characters."""
    raw, at = text_bytes(column)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    hot = np.flatnonzero(p >= 0.5)
    new = np.ones(len(hot), bool)
    new[1:] = (np.diff(hot) != 1) | (text[hot[1:]] != text[hot[:-1]])
    end = np.ones(len(hot), bool)
    end[:-1] = new[1:]
    owner = text[hot[new]]
    base = chars[at[owner]]
    values = pa.StructArray.from_arrays([pa.array(chars[first[hot[new]]] - base), pa.array(chars[last[hot[end]]] - base)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(column) + 1)), pa.int32()), values)
