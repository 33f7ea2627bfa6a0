"""Nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volfuse.llm import ann, queries


def brute(rows, k):
    """The k nearest of every id divisible by 20."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(axis=1)
        own = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in own]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        assert r["rank"] == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 6)) * rng.exponential(1, (300, 1)), 1)
    x[40:140] = x[20]
    x[(x == 0).all(axis=1)] = 1
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32).astype(float))]
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None), (1020, [0.0] * 6), (1040, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1060, [nan] * 6), (1080, [inf] * 6), (1100, []), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 0, 0) for r in [*rows, *odd, rows[7], rows[20]]], "vec_id long, embedding array<float>, ids int, dim int")
    got = found(ann.nearest(df, F.col("vec_id") % 20 == 0))
    want = brute(rows, 20)
    assert set(got) == set(want)
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    assert found(ann.nearest(df, F.col("vec_id") % 20 == 0)) == {0: [(1, 1.0)]}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_recall_over_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 48)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(ann.nearest(df, F.col("vec_id") % 20 == 0, trees=64, candidates=400, block=1000, queries_block=150))
    want = brute(rows, 20)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("candidates", [1, 50, 500])
def test_forest_gives_enough(candidates):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(200, 8)), rng.normal(size=(20, 8))
    got = dict(ann.Forest(x, trees=4).search(q, candidates))
    assert set(got) == set(range(20)) and all(len(v) >= min(candidates, 200) for v in got.values())


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(queries.op10_nearest(spark, sf)), brute(rows, 20)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)
