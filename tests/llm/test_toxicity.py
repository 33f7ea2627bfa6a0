"""The field: marginals against plain recursion, held-out labels, spans."""

import numpy as np
import pyarrow as pa
import pytest

from volfuse.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_marginals(n):
    rng = np.random.default_rng(n)
    score, begins = rng.normal(size=n) * 3, rng.random(n) < 0.1
    begins[0] = True
    start, move = np.array([0.9, 0.1]), np.array([[2.0, 0.3], [0.5, 1.5]])
    got = toxicity.marginals(*toxicity.chain(score, begins, start, move))
    want, cuts = [], [*np.flatnonzero(begins), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        ahead, behind = [start * [1, np.exp(score[a])]], [np.ones(2)]
        for t in range(a + 1, b):
            step = ahead[-1] @ move * [1, np.exp(score[t])]
            ahead.append(step / step.sum())
        for t in range(b - 1, a, -1):
            step = move @ ([1, np.exp(score[t])] * behind[0])
            behind.insert(0, step / step.sum())
        want += [(x * y)[1] / (x * y).sum() for x, y in zip(ahead, behind, strict=True)]
    assert np.allclose(got, want)


def test_held_out(spark):
    rows = queries.op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    clean = [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    high, low = ([r.score for r in held if r.toxic == y] for y in (1, 0))
    assert np.mean([[a > b for b in low] for a in high]) > 0.8


@pytest.fixture(scope="module")
def field(spark):
    words = ["one", "two", "three", "four", "five"]
    rng = np.random.default_rng(5)
    rows = [(k, " ".join([*rng.choice(words, 30), *(["Grubby", "grubbest"] if k % 4 == 0 else []), *rng.choice(words, 9)])) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    return toxicity.fit(docs, labels, labels["doc_id"] >= 0)


def test_spans(spark, field):
    rows = [(1, "é two grubby, grubbish four", 1), (2, "one two", 1), (3, None, 1), (4, "", 1), (5, "12 !", 1), (5, "12 !", 1), (6, "one " * 100_000 + "grubby", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = {r.doc_id: r for r in toxicity.score(docs, field).collect()}
    hit = [rows[0][1][s["start"] : s["end"]] for s in out[1].spans]
    assert hit in (["grubby, grubbish"], ["grubby", "grubbish"]) and out[1].score > 0.5
    assert all(out[k].spans == [] and out[k].score < 0.5 for k in (2, 3, 4, 5))
    assert [(s["start"], s["end"]) for s in out[6].spans] == [(400_000, 400_006)]
    assert toxicity.score(docs.limit(0), field).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels, labels["doc_id"] > 0) is None
    assert toxicity.fit(docs.limit(0), labels.limit(0), labels["doc_id"] > 0) is None
    assert [r.score for r in toxicity.score(docs, None).collect()] == [0.0, 0.0]


def test_no_tokens(field):
    p, _, _, text = field.tag(pa.array(["", None, "1 2"], pa.string()))
    assert len(p) == len(text) == 0


def test_scores_mean_the_same_when_the_sample_is_bounded(spark):
    """A tenth is toxic, half of it without a sign: a text without one is toxic in 1 of 19 cases, however few rows are drawn."""
    rng = np.random.default_rng(7)
    words = ["one", "two", "three", "four", "five"]
    rows = [(k, " ".join([*rng.choice(words, 20), *(["grubby"] if k % 20 == 0 else [])]), int(k % 10 == 0)) for k in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    plain = spark.createDataFrame([(1, "two three one five"), (2, "one grubby two")], "doc_id long, text string")
    for toxic_rows, clean_rows in ((600, 10_000), (600, 500), (120, 240)):
        field = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"), table["doc_id"] >= 0, toxic_rows, clean_rows)
        out = {r.doc_id: r.score for r in toxicity.score(plain, field).collect()}
        assert 0.03 < out[1] < 0.08 and out[2] > 0.9
