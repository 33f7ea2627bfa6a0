"""Whitening against numpy on the same whole numbers."""

import numpy as np
import pytest

from volfuse.llm import queries, whitening

SCHEMA = "vec_id long, vector array<float>, n int, component string"


def brute(vectors, components=8):
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * c - s for c, s in zip(row, sums, strict=True)] for row in x]
    z = np.array([[c / n for c in row] for row in y])
    values, turn = np.linalg.eigh(z.T @ z / n)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    return [sum(c * c for c in row) for row in y], z @ turn / np.sqrt(values), values / (np.square(z).sum() / n), turn


def table(out):
    ids = sorted({r.vec_id for r in out})
    cell = {(r.vec_id, r.component): r for r in out}
    return ids, cell


def check(spark, vectors, components=8):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(vectors)], SCHEMA)
    ids, cell = table(whitening.whitened(df, components).collect())
    deviation, white, share, _ = brute(vectors, components)
    assert len(ids) == len(vectors)
    sign = np.array([np.sign(sum(cell[i, k + 1].whitened * white[i, k] for i in ids)) for k in range(white.shape[1])])
    for i in ids:
        got = [cell[i, k + 1] for k in range(white.shape[1])]
        np.testing.assert_allclose([r.whitened for r in got] * sign, white[i], atol=1e-8)
        np.testing.assert_allclose([r.explained for r in got], share, rtol=1e-9)
        assert {(r.n, r.deviation) for r in got} == {(len(ids), deviation[i])}
        assert all(r.identity_error < 1e-10 for r in got)


@pytest.mark.parametrize("d", [9, 32, 33, 60])
def test_against_numpy(spark, d):
    rng = np.random.default_rng(d)
    check(spark, (rng.standard_normal((300, d)) * np.linspace(1, 2, d)).astype(np.float32).tolist())


def test_steep_spectrum(spark):
    rng = np.random.default_rng(3)
    check(spark, (rng.standard_normal((200, 50)) * 0.8 ** np.arange(50)).astype(np.float32).tolist(), 4)


def test_few_directions(spark):
    """Vectors in a plane have two components, also if the block doesn't hold all dimensions."""
    rng = np.random.default_rng(4)
    plane = np.zeros((100, 40), np.float32)
    plane[:, 3], plane[:, 7] = rng.integers(0, 9, 100), rng.integers(0, 5, 100)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(plane.tolist())], SCHEMA)
    out = whitening.whitened(df).collect()
    assert {r.component for r in out} == {1, 2} and len(out) == 200
    assert sum(r.explained for r in out if r.vec_id == 0) == pytest.approx(1)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (None, [2.0, 1.0]), (3, [5.0, 5.0]), (3, [5.0, 5.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    out = whitening.whitened(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 2), (3, 1), (3, 1), (3, 2), (3, 2)]
    assert {r.n for r in out} == {4}
    for less in (df.limit(0), df.where("vec_id = 1"), df.where("vec_id = 3"), df.where("vec_id = 5")):
        assert whitening.whitened(less).collect() == []
    assert whitening.whitened(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries(spark):
    """Sums and deviations are whole numbers beyond what doubles hold; beyond 64 bits they are null."""
    big = 2.0**40
    rows = [(1, [big, 0.0]), (2, [big, 1.0]), (3, [-big, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    x = [[int(1024 * c) + 100000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for (i, _), v in zip(rows, x, strict=True)}
    got = {r.vec_id: r.deviation for r in whitening.whitened(df).collect()}
    assert got == {i: v if v < 2**63 else None for i, v in want.items()}
    small = spark.createDataFrame([(i, [c / 2**25 for c in v]) for i, v in rows], "vec_id long, vector array<double>")
    assert all(r.deviation is not None for r in whitening.whitened(small).collect())


def test_passes_are_certified(spark):
    """The residuals of the returned pairs, measured apart from the iteration."""
    rng = np.random.default_rng(7)
    v = rng.standard_normal((500, 64)).astype(np.float32).tolist()
    rows = whitening.integers(spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, vector array<float>"))
    model = whitening.fit(rows)
    x = np.array([r.x for r in rows.collect()], float)
    cov = np.cov(x.T, bias=True)
    assert np.abs(cov @ model.components - model.components * model.values).max() < 1e-11 * model.values[0]
    np.testing.assert_allclose(model.values, np.linalg.eigvalsh(cov)[::-1][:8], rtol=1e-12)
    assert model.passes > 1


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    ids, cell = table(queries.op12_whitening(spark, path).collect())
    deviation, white, share, _ = brute([r.embedding for r in rows])
    assert sorted(r.vec_id for r in rows) == ids
    for k in range(8):
        got = np.array([cell[r.vec_id, k + 1].whitened for r in rows])
        np.testing.assert_allclose(got * np.sign(got @ white[:, k]), white[:, k], atol=1e-7)
    assert [cell[r.vec_id, 1].deviation for r in rows] == deviation
    np.testing.assert_allclose([cell[ids[0], k + 1].explained for k in range(8)], share, rtol=1e-9)
