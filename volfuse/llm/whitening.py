"""Principal components by Chebyshev-filtered subspace iteration, and vectors whitened on them.

A block of directions Q, more than are asked for, is multiplied by the covariance of the centred vectors in
distributed passes, XᵀXQ / n. A pass needs one product a batch; tasks' sums are added by four tasks and then on the
driver, so what the driver gets doesn't grow with the rows or the tasks. A Chebyshev polynomial over [0, smallest
Ritz value], by its three-term recurrence, damps the unwanted part of the spectrum; then follow QR, Rayleigh-Ritz
and the residuals of the wanted pairs. The rounds end when these are below 1e-13 of the largest eigenvalue.

Entries become whole numbers, floor(1024 c) + 100000; their sums, and the deviations sum((n x - S)^2), are exact.
Deviations beyond 64 bits are null.

Vectors that are null, empty, or hold null or non-finite entries are left out, and so are those of another length
than the most common one (the longer of several). Equal vectors and rows that share an id stay apart; null ids
stay null; columns other than ``vec_id`` and ``vector`` take no part. Components without variance are left out: a
table of one vector, or of equal ones, has none and gives no rows, like an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volfuse.llm.staging import stage

SCALE, SHIFT = 1024, 100_000
BLOCK = 32
DEGREE = 10
TOLERANCE = 1e-13
#: The most by which a filter may raise one wanted direction above another.
GROWTH = 1e7
ROUNDS = 200
#: Tasks that add up the sums of all others.
FAN = 4
#: Eigenvalues below this share of the largest are zero but for rounding.
NO_VARIANCE = 1e-12


class Fit(NamedTuple):
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int


def integers(df: DataFrame) -> DataFrame:
    """``vec_id`` and ``x``, the whole numbers of the vectors that take part."""
    entry = F.transform("vector", lambda c: c.cast("double"))
    finite = F.forall("e", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), entry.alias("e")).where(F.col("e").isNotNull() & (F.size("e") > 0) & finite)
    x = F.transform("e", lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    rows = stage(rows.select("vec_id", x.alias("x")), "vectors")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    length = [r.d for r in common.collect()]
    return rows.where(F.size("x") == (length[0] if length else 0))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, one in each row."""
    column = batch.column("x")
    return column.flatten().to_numpy().reshape(batch.num_rows, -1)


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``part`` over all batches of vectors."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(matrix(batch))
                total = got if total is None else total + got
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["total"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for cell in batch.column("total"):
                got = np.frombuffer(cell.as_buffer(), kind)
                total = got if total is None else total + got
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["total"])

    kind = part.kind
    parts = rows.select("x").mapInArrow(own, "total binary").repartition(FAN).mapInArrow(added, "total binary").collect()
    return sum(np.frombuffer(bytes(r.total), kind) for r in parts) if parts else None


class Sums:
    """Number of vectors and sum of every dimension, the latter in two halves of 32 bits."""

    kind = np.int64

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])


class Centred:
    """Vectors less their mean: whole numbers n x - S where 64 bits hold them, divided by n."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.mean = np.array([float(s / n) if s % n else float(s // n) for s in sums])
        self.whole = np.array([s if abs(s) < 1 << 62 else 0 for s in sums], np.int64)
        self.fits = all(abs(s) < 1 << 62 for s in sums)

    def exact(self, x: np.ndarray) -> bool:
        return self.fits and (not x.size or int(np.abs(x).max()) * self.n < 1 << 62)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.exact(x):
            return (x * self.n - self.whole) / self.n
        return x - self.mean

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - S)^2) of every row, exactly."""
        if self.exact(x):
            y = x * self.n - self.whole
            if float((y.astype(float) ** 2).sum(axis=1).max(initial=0)) < 2**62:
                return (y * y).sum(axis=1).tolist()
        out = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in out]


class Product:
    """XᵀXQ of centred vectors."""

    kind = np.float64

    def __init__(self, centred: Centred, q: np.ndarray):
        self.centred, self.q = centred, q

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self.centred(x)
        return (z.T @ (z @ self.q)).ravel()


class Trace(Product):
    """Sum of the squares of all entries."""

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.array([np.square(self.centred(x)).sum()])


class Moments(Product):
    """Sums and products of the whitened vectors; ``q`` takes a centred vector to a whitened one."""

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w = self.centred(x) @ self.q
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])


def filtered(multiply: Callable, u: np.ndarray, vu: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A Chebyshev polynomial of the covariance, small between 0 and the least of ``values``, times ``u``."""
    half = values[-1] / 2
    if half <= NO_VARIANCE * values[0]:
        return vu
    before, now = u, (vu - half * u) / half
    degree = int(min(DEGREE, max(2, np.arccosh(GROWTH) / np.arccosh(max(1.0 + 1e-9, values[0] / half - 1)))))
    for _ in range(degree - 1):
        size = np.linalg.norm(now, axis=0)
        before, now = before / size, now / size
        before, now = now, 2 * (multiply(now) - half * now) / half - before
    return now / np.linalg.norm(now, axis=0)


def fit(rows: DataFrame, components: int = 8, block: int = BLOCK, seed: int = 0) -> Fit | None:
    """The largest components of the vectors' covariance; none without vectors."""
    sums = summed(rows, Sums())
    if sums is None:
        return None
    n, d = int(sums[0]), (len(sums) - 1) // 2
    exact = [(int(a) << 32) + int(b) for a, b in zip(sums[1 : d + 1], sums[d + 1 :], strict=True)]
    centred = Centred(n, exact)
    trace = float(summed(rows, Trace(centred, np.zeros(0)))[0]) / n
    k = min(d, max(block, 2 * components))
    passes = 0

    def multiply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return summed(rows, Product(centred, q)).reshape(d, -1) / n

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, k)))[0]
    if not trace > 0:
        return Fit(n, exact, np.zeros((d, 0)), np.zeros(0), trace, passes)
    for _ in range(ROUNDS):
        vq = multiply(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        u, vu = q @ turn, vq @ turn
        rest = np.linalg.norm(vu - u * values, axis=0)[:components]
        if k == d or rest.max() <= TOLERANCE * values[0]:
            break
        q = np.linalg.qr(filtered(multiply, u, vu, values))[0]
    else:
        raise RuntimeError(f"residuals are still {rest.max() / values[0]:.1e} of the largest eigenvalue")
    keep = min(components, int((values > NO_VARIANCE * values[0]).sum()))
    return Fit(n, exact, u[:, :keep], values[:keep], trace, passes)


def transform(rows: DataFrame, model: Fit) -> DataFrame:
    """For every vector and component: id, component, ``n``, ``deviation`` and the whitened value."""
    centred, m = Centred(model.n, model.sums), len(model.values)
    turn = model.components / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                x = matrix(part)
                row = np.repeat(np.arange(len(x)), m)
                columns = [
                    part.column("vec_id").take(pa.array(row)),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(row), model.n)),
                    pa.array(centred.deviation(x), pa.int64()).take(pa.array(row)),
                    pa.array((centred(x) @ turn).ravel()),
                ]
                yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double")


def identity_error(rows: DataFrame, model: Fit) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, measured on all of them."""
    m = len(model.values)
    got = summed(rows, Moments(Centred(model.n, model.sums), model.components / np.sqrt(model.values))) / model.n
    mean, second = got[:m], got[m:].reshape(m, m)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max())


def whitened(df: DataFrame, components: int = 8) -> DataFrame:
    """``transform`` by the fit on all vectors, with every component's share of the variance and the error."""
    rows = integers(df)
    model = fit(rows, components)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    share = F.element_at(F.array(*[F.lit(float(v / model.trace)) for v in model.values]), F.col("component"))
    return transform(rows, model).withColumns({"explained": share, "identity_error": F.lit(identity_error(rows, model))})
