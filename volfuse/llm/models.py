"""Small linear models fitted on the driver from a bounded number of sparse rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


#: Entries that are multiplied out at once.
ENTRIES = 1 << 18


def _row_blocks(bounds: np.ndarray) -> Iterator[tuple[int, int, slice, np.ndarray]]:
    """Rows of some ``ENTRIES`` entries: the first and the last but one, their entries, and the row of each entry."""
    first = 0
    while first + 1 < len(bounds):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + ENTRIES, "right")) - 1)
        owner = np.repeat(np.arange(last - first), np.diff(bounds[first : last + 1]))
        yield first, last, slice(int(bounds[first]), int(bounds[last])), owner
        first = last


def margins(bounds: np.ndarray, feature: np.ndarray, value: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum of value times weight for every row."""
    out = np.zeros(len(bounds) - 1)
    for first, last, part, owner in _row_blocks(bounds):
        out[first:last] = np.bincount(owner, value[part] * w[feature[part]], last - first)
    return out


def fit_sparse(
    bounds: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, size: int, l2: float = 1e-4, steps: int = 150, rate: float = 0.5
) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam steps; both classes weigh the same. Row i holds the features and values
    from bounds[i] to bounds[i + 1]; only a block of entries is multiplied out at a time."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        g = np.zeros(size + 1)
        for first, last, part, owner in _row_blocks(bounds):
            own, share = feature[part], value[part]
            z = np.bincount(owner, share * w[own], last - first) + w[-1]
            error = weight[first:last] * (sigmoid(z) - y[first:last])
            g[:-1] += np.bincount(own, share * error[owner], size)
            g[-1] += error.sum()
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on a few columns by Newton's method; both classes keep their frequency, or that of their weights."""
    a = np.column_stack([x, np.ones(len(x))])
    part = np.full(len(y), 1 / len(y)) if weight is None else weight / weight.sum()
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ (part * (p - y)) + l2 * w
        h = (a * (part * p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])
