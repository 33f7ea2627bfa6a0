"""Counts against plain Python; the classifier on held-out labels."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F
from volfuse.llm import quality, queries
from volfuse.llm.texts import SPACE, hash_spans, per_text, text_bytes, words

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    own = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    three = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    inside = {i + j for i in range(len(own) - 2) if three[tuple(own[i : i + 3])] > 1 for j in range(3)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return [len(own), sum(map(len, own)), symbols, dup, len(inside)]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("ab \n\té#|漢")), max_size=60)), max_size=8))
def test_counts(rows):
    raw, at = text_bytes(pa.array(rows, pa.string()))
    first, last, text = words(raw, at)
    solid = ~SPACE[raw]
    dup = quality.dup_lines(raw, at, solid)
    again = quality.repeat_words(hash_spans(raw, first, last), text, len(rows))
    chars = per_text(solid & ((raw & 0xC0) != 0x80), at)
    want = [counted(t) for t in rows]
    assert [[int(x) for x in dup], [int(x) for x in again], [int(x) for x in chars]] == [[w[i] for w in want] for i in (3, 4, 1)]


def test_query_counts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op7_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = counted(docs[r.doc_id])
        assert [r[c] for c in quality.COUNTS] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and (not failed or not r.kept) and r.kept == (not failed and r.score >= 0.5)


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("n_words >= 50").collect()
    assert sum((r.score >= 0.5) == bool(r.quality) for r in rows) >= 0.97 * len(rows)


def test_without_labels(spark):
    rows = [(1, "a b c " * 30, 1), (2, None, 2), (2, None, 2), (None, "x", 3), (4, " ".join(map(str, range(60))), 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, none) is None
    one = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert quality.fit(docs, one) is None
    out = {r.doc_id: r for r in quality.score(docs, None).collect()}
    assert out[1].base_failed and out[2].n_words == 0 and not out[2].kept and out[4].kept
    assert quality.score(docs.limit(0), None).collect() == []


def test_bounded_sample_is_fixed(spark):
    from volfuse.llm.texts import bounded_sample

    df = spark.range(5000).select(F.col("id").alias("doc_id"))
    a = {r.doc_id for r in bounded_sample(df, "doc_id", 500).collect()}
    assert 400 < len(a) < 600 and a == {r.doc_id for r in bounded_sample(df.repartition(3), "doc_id", 500).collect()}


def test_all_of_3000_labelled_rows_are_used(spark, monkeypatch):
    used, fit_dense = [], quality.fit_dense
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two "), F.col("id") % 2).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(quality, "fit_sparse", lambda bounds, feature, value, y, size: used.append(len(y)) or (np.zeros(size), 0.0))
    monkeypatch.setattr(quality, "fit_dense", lambda x, y, weight: used.append(len(y)) or fit_dense(x, y, weight=weight))
    quality.fit(docs, labels)
    assert sum(used) == 3000


def test_a_rare_label_is_learned(spark):
    """Three bad rows in 20,000: the sample holds them all, whatever the bound."""
    word = F.when(F.col("id") % 7000 == 5, "junk ").otherwise("good ")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(word, 60).alias("text"))
    labels = docs.select("doc_id", (~F.col("text").startswith("junk")).cast("int").alias("quality"))
    sample, stands_for = quality.both_labels(labels.withColumnRenamed("quality", "y"), 400)
    counts = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    assert counts[0] == 3 and 330 < counts[1] < 470 and stands_for[0] == 1.0 and abs(stands_for[1] - 19997 / 397) < 1e-9
    model = quality.fit(docs, labels, 400, held=0.0)
    few = docs.where("doc_id % 1000 = 5")
    got = {r.doc_id: r.score for r in quality.score(few, model).collect()}
    assert all((got[i] >= 0.5) == (i % 7000 != 5) for i in got)


def test_scores_mean_the_same_at_every_size(spark):
    """The share of good rows stays in the scores when the sample holds either label half and half."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same words " * 20).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    for rows in (400, 4000):
        score = quality.score(docs.limit(1), quality.fit(docs, labels, rows)).first().score
        assert abs(score - 0.9) < 0.06


def test_sparse_rows_equal_dense_ones(monkeypatch):
    from volfuse.llm import models

    rng = np.random.default_rng(1)
    x = rng.random((40, 9)) * (rng.random((40, 9)) < 0.4)
    x[7] = 0
    y = (x[:, 2] > 0).astype(float)
    bounds = np.concatenate([[0], np.cumsum((x > 0).sum(axis=1))])
    feature, value = np.nonzero(x)[1].astype(np.int32), x[x > 0].astype(np.float32)
    whole = models.fit_sparse(bounds, feature, value, y, 9)
    monkeypatch.setattr(models, "ENTRIES", 5)
    parts = models.fit_sparse(bounds, feature, value, y, 9)
    np.testing.assert_allclose(whole[0], parts[0], atol=1e-9)
    np.testing.assert_allclose(models.margins(bounds, feature, value, whole[0]), x.astype(np.float32) @ whole[0], atol=1e-6)
    assert (((x @ whole[0] + whole[1]) > 0) == (y > 0)).mean() > 0.9


def test_shares_have_fine_steps(spark):
    from volfuse.llm.texts import share

    low = spark.range(3_000_000).where(share(F.col("id")) < 1e-6).count()
    assert low < 20 and spark.range(200_000).select(share(F.col("id")).alias("s")).distinct().count() == 200_000
