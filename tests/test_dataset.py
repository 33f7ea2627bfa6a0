import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import at, column, prices
from volfuse.operators import dataset
from volfuse.operators.dataset import MinMax
from volfuse.operators.fusion import fuse, match_count, within_range_of
from volfuse.operators.series import Series
from volfuse.schema import FEATURES, TARGET


def test_range_includes_both_ends(spark):
    df = prices(spark, [1.0, 2.0, 3.0], first=23)  # 23:00, 00:00, 01:00
    kept = dataset.time_range(df, "2024-01-01", "2024-01-02")
    assert column(kept, "hour") == [at(23), at(24)]
    assert dataset.time_range(df).count() == 3


def test_range_of_another_table(spark):
    inner, outer = prices(spark, [1.0, 2.0], first=5), prices(spark, [float(i) for i in range(20)])
    assert column(within_range_of(outer, inner), "hour") == [at(5), at(6)]


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 8, 11, 12, 100])
def test_first_n_equals_a_sorted_head(spark, n):
    """Few distinct times, so most cuts fall into ties; rows without a time come last."""
    rows = [(i, None if i % 4 == 3 else at(i % 2)) for i in range(12)]
    random.Random(n).shuffle(rows)
    df = spark.createDataFrame(rows, "post_id bigint, timestamp timestamp_ntz").repartition(3)
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or at(0), r[0]))[:n]
    got = [(r["post_id"], r["timestamp"]) for r in dataset.first_n(df, n).collect()]
    assert sorted(got) == sorted(want)


def test_first_n_with_one_hot_time(spark):
    df = spark.range(5000).select(F.col("id").alias("post_id"), F.lit(at(0)).cast("timestamp_ntz").alias("timestamp"))
    got = dataset.first_n(df, 1234)
    assert (got.count(), got.agg(F.max("post_id")).first()[0]) == (1234, 1233)


def test_last_n(spark):
    df = prices(spark, [float(i) for i in range(9)]).unionByName(prices(spark, [1.0, 2.0], "b"))
    got = dataset.last_n(df, 3)
    assert column(got.filter("symbol = 'a'"), "close") == [6.0, 7.0, 8.0]
    assert got.filter("symbol = 'b'").count() == 2


def test_project_adds_defaults_only(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    got = dataset.project(df, ["b", "missing", "c"], {"c": 0})
    assert got.columns == ["b", "c"] and got.first()["c"] == 0


def test_split(spark):
    df = prices(spark, [float(i) for i in range(10)])
    assert column(dataset.time_split(df), "split") == ["train"] * 8 + ["test"] * 2
    assert column(dataset.time_split(df, embargo=3), "split") == ["train"] * 5 + ["embargo"] * 3 + ["test"] * 2
    (row,) = dataset.split_bounds(df).collect()
    assert (row["n_train"], row["n_test"], row["train_end"], row["test_start"]) == (8, 2, at(7), at(8))


def test_scaling(spark):
    train = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "x double, c double")
    scaler = MinMax.fit(train, ["x", "c"])
    other = spark.createDataFrame([(20.0, 5.0), (5.0, 6.0)], "x double, c double")
    scaled = scaler.transform(other)
    assert [tuple(r) for r in scaled.collect()] == [(2.0, 0.0), (0.5, 1.0)]
    assert [tuple(r) for r in scaler.inverse(scaled, {"x": "x", "c": "c"}).collect()] == [(20.0, 5.0), (5.0, 6.0)]


@pytest.mark.parametrize("block", [4096, 16])
def test_sequences(spark, block):
    df = prices(spark, [float(i) for i in range(31)]).filter("close != 5")  # rows count, not hours
    seq = dataset.sequences(df, ["close", "high"], "close", 12, Series(rows=block), share=0.8)
    rows = seq.orderBy("label_ts").collect()
    values = [float(i) for i in range(31) if i != 5]
    assert len(rows) == 18
    for i, row in enumerate(rows):
        assert row["x"] == [[v, v + 1] for v in values[i : i + 12]]
        assert row["label"] == values[i + 12]
    assert [r["split"] for r in rows] == ["train"] * 14 + ["test"] * 4
    flat = dataset.last_step(seq, ["close", "high"]).orderBy("label_ts").first()
    assert (flat["close"], flat["high"]) == (12.0, 13.0)
    shifted = dataset.previous_step(df, ["close"], Series(rows=block))
    assert column(shifted, "close") == values[:-1]


def test_model_matrix(spark):
    columns = ["symbol", "hour", *FEATURES, TARGET]
    good = ["a", at(0), *[float(i) for i in range(18)], 0.5]
    rows = [good, ["a", at(1), *good[2:5], float("inf"), *good[6:]], ["a", at(2), *good[2:-1], None]]
    schema = "symbol string, hour timestamp_ntz, " + ", ".join(f"`{c}` double" for c in columns[2:])
    (row,) = dataset.model_matrix(spark.createDataFrame([tuple(r) for r in rows], schema)).collect()
    assert row["volume"] == pytest.approx(math.log1p(4.0)) and row["close"] == 3.0


# --- fusion -------------------------------------------------------------------------------------

SENT = "hour timestamp_ntz, sentiment_score double, tweet_count bigint, likes double, retweets double"


def sentiment(spark, *hours):
    return spark.createDataFrame([(at(h), 0.1 * (h + 1), 2, 3.0, 4.0) for h in hours], SENT)


@pytest.mark.parametrize("block", [4096, 3])
def test_scores_last_and_counts_do_not(spark, block):
    fused = fuse(prices(spark, [1.0] * 8, first=1), sentiment(spark, 0, 2, 6, 30), Series(rows=block))
    assert column(fused, "sentiment_score") == pytest.approx([0, 0.3, 0.3, 0.3, 0.3, 0.7, 0.7, 0.7])
    assert column(fused, "tweet_count") == [0, 2, 0, 0, 0, 2, 0, 0]
    weight = math.log1p(3 + 4 + 1)
    assert column(fused, "weighted_sentiment")[4] == pytest.approx(0.3 * weight)
    assert tuple(match_count(fused).first()) == (8, 2)


def test_age_limit(spark):
    fused = fuse(prices(spark, [1.0] * 6), sentiment(spark, 1), max_age=2)
    assert column(fused, "sentiment_score") == pytest.approx([0, 0.2, 0.2, 0.2, 0, 0])
    assert column(fused, "weighted_sentiment")[4] == 0


def test_own_weight_is_kept_and_missing_columns_are_zero(spark):
    own = sentiment(spark, 0).withColumn("weighted_sentiment", F.lit(9.0))
    assert column(fuse(prices(spark, [1.0]), own), "weighted_sentiment") == [9.0]
    bare = sentiment(spark, 0).select("hour", "sentiment_score")
    row = fuse(prices(spark, [1.0]), bare).first()
    assert (row["tweet_count"], row["likes"], row["weighted_sentiment"]) == (0.0, 0.0, 0.0)


def test_name_clash_gets_a_suffix(spark):
    price = prices(spark, [1.0]).withColumn("likes", F.lit(8.0))
    row = fuse(price, sentiment(spark, 0)).first()
    assert (row["likes"], row["likes_sent"]) == (8.0, 3.0)


def test_symbols_carry_their_own_scores(spark):
    """The second symbol starts after the only post hour and must not inherit it."""
    both = prices(spark, [1.0] * 4).unionByName(prices(spark, [1.0] * 3, "b", first=1))
    fused = fuse(both, sentiment(spark, 0))
    assert column(fused.filter("symbol = 'a'"), "sentiment_score") == pytest.approx([0.1] * 4)
    assert column(fused.filter("symbol = 'b'"), "sentiment_score") == [0.0] * 3


def test_nothing_is_dropped_by_a_left_join(spark):
    fused = fuse(prices(spark, [float(i) for i in range(50)]), sentiment(spark, 100))
    assert fused.count() == 50 and set(column(fused, "sentiment_score")) == {0.0}
    assert np.allclose(column(fused, "close"), range(50))
    assert fused.schema["hour"].dataType.simpleString() == "timestamp_ntz" and isinstance(fused.first()["hour"], datetime)
