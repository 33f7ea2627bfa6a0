from datetime import datetime

import pytest
from pyspark.sql import functions as F

from volfuse.functions import casts
from volfuse.functions.scores import fixed, regime, signed_score
from volfuse.functions.text import clean_text
from volfuse.operators import sentiment

CLEAN = [
    ("RT @ömer Tom &amp; Al https://x.y/z #btc  up", "Tom & Al btc up"),
    ("@a hi", "hi"),
    (None, ""),
    ("RT", ""),
    ("ART RTs RT_ xRT", "ART RTs RT_ xRT"),
    ("ÖRT RTé RT.", "ÖRT RTé ."),
    ("a  b\tc\n\nd \x1c e\x85f", "a b c d e f"),
    ("&lt;b&gt; &#39;q&#39; &copy; &&& x", "<b> 'q' © &&& x"),
    ("see http://a.b/c?d=e&f=g,now http", "see http"),
    ("httpx", ""),
    ("&#64;user hello", "hello"),
    ("mail me@you_x.com", "mail me.com"),
    ("##a #b", "a b"),
]


def test_cleaning(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEAN)], "i int, text string")
    got = [r[0] for r in df.withColumn("c", clean_text("text")).orderBy("i").select("c").collect()]
    assert got == [b for _, b in CLEAN]


def test_short_texts_are_dropped(spark):
    posts = spark.createDataFrame(
        [("2024-01-01 00:10:00", "@a hi", "1"), ("nope", "@a hey", "3.7"), ("2024-01-01T01:00:00+02:00", "good", None)],
        "timestamp string, text string, likes string",
    )
    got = sentiment.clean_posts(posts).orderBy("text").collect()
    assert [(r["text"], r["timestamp"], r["likes"], r["replies"], r["retweets"]) for r in got] == [
        ("good", datetime(2023, 12, 31, 23), 0, 0, 0),
        ("hey", None, 3, 0, 0),
    ]
    assert sentiment.min_chars(posts, 6).count() == 1


def test_counts(spark):
    values = ["3.7", "x", None, "12", "-2.9", "nan", "inf", "9007199254740993", "1e3", "1e300", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(casts.to_count("v")).collect()]
    assert got == [3, 0, 0, 12, -2, 0, 0, 9007199254740993, 1000, 0, 0]


def test_times(spark):
    values = ["1704067200", "1704067200.5", "2024-01-01 03:00:00", "2024-01-01 03:00:00+03:00", "bad", None, "nan"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(casts.to_ts("v")).collect()]
    day = datetime(2024, 1, 1)
    assert got == [day, day.replace(microsecond=500000), day.replace(hour=3), day, None, None, None]
    row = spark.range(1).select(casts.to_utc(F.lit("2024-07-01 03:00:00").cast("timestamp_ntz"), "Europe/Berlin").alias("t")).first()
    assert row["t"] == datetime(2024, 7, 1, 1)


def test_finite(spark):
    df = spark.createDataFrame([(1, 1.5), (2, float("nan")), (3, float("inf")), (4, float("-inf")), (5, None)], "i int, v double")
    assert [r["v"] for r in casts.finite_columns(df).orderBy("i").collect()] == [1.5, None, None, None, None]


def test_signed_score(spark):
    df = spark.createDataFrame([("Positive", 0.9), ("NEG", 0.8), ("neutral", 0.7)], "l string, p double")
    assert [r[0] for r in df.select(signed_score("l", "p")).collect()] == [0.9, -0.8, 0.0]


def test_regimes(spark):
    df = spark.createDataFrame([(0.0049,), (0.005,), (0.0149,), (0.015,), (None,)], "v double")
    assert [r[0] for r in df.select(regime("v")).collect()] == ["low", "normal", "normal", "high", None]
    assert spark.range(1).select(fixed(F.lit(1234.5))).first()[0] == "1234.500000"


def test_lexicon(spark):
    df = spark.createDataFrame([("with FOR is",), ("is it on",), ("nothing here",), ("",)], "text string")
    got = sentiment.lexicon_scorer(df).collect()
    assert [r["sentiment_score"] for r in got] == pytest.approx([1 / 3, -1.0, 0.0, 0.0])
    assert [r["label"] for r in got] == ["positive", "negative", "neutral", "neutral"]


def test_any_scorer_in_small_batches(spark):
    def load():
        calls = []

        def model(texts):
            calls.append(len(texts))
            assert len(texts) <= 4
            return [("positive" if "up" in t else "negative", 0.5) for t in texts]

        return model

    df = spark.createDataFrame([(i, "up" if i % 3 else "down") for i in range(50)] + [(50, None)], "i int, text string")
    got = {r["i"]: r["sentiment_score"] for r in sentiment.score_posts(df, load, batch=4).collect()}
    assert got == {i: (0.5 if i % 3 else -0.5) for i in range(50)} | {50: -0.5}


def test_scorer_holds_few_texts_at_once(spark):
    """Of 40 MB of different texts only those of a call are Python strings; with all of them 80 MB were held, now 65."""

    def load():
        import tracemalloc

        tracemalloc.start()
        return lambda texts: [("positive", tracemalloc.get_traced_memory()[0] / 1e6)] * len(texts)

    df = spark.range(0, 2000, 1, 1).select(F.concat("id", F.repeat(F.lit(" word"), 4000)).alias("text"))
    assert sentiment.score_posts(df, load, batch=8).agg(F.max("probability")).first()[0] < 72


def test_scores_of_odd_values(spark):
    """Missing labels and probabilities, whole numbers, and a partition without rows."""

    def load():
        return lambda texts: [{"a": ("positive", 1), "b": (None, float("nan"))}.get(t, ("neutral", None)) for t in texts]

    df = spark.createDataFrame([("a",), ("b",), ("c",)], "text string").repartition(5)
    got = {r["text"]: (r["label"], r["probability"]) for r in sentiment.score_posts(df, load).collect()}
    assert got == {"a": ("positive", 1.0), "b": (None, None), "c": ("neutral", None)}
    assert sentiment.score_posts(df.where("text = 'x'"), load).collect() == []


def test_entities_of_many_texts(spark):
    """More texts than are decoded at a time, some without an entity or missing."""
    df = spark.range(0, 200, 1, 2).select("id", F.expr("if(id % 3 = 0, null, concat(if(id % 2 = 0, '&amp;', 'x'), id))").alias("text"))
    got = {r["id"]: r["c"] for r in df.select("id", clean_text("text").alias("c")).collect()}
    assert got == {i: "" if i % 3 == 0 else f"{'x' if i % 2 else '&'}{i}" for i in range(200)}


def test_hourly_index(spark):
    posts = spark.createDataFrame(
        [
            (datetime(2024, 1, 1, 0, 5), "a", 1.0, 10, 0),
            (datetime(2024, 1, 1, 0, 55), "b", -0.5, 20, 4),
            (datetime(2024, 1, 1, 2, 0), "c", None, 1, 1),
            (None, "d", 1.0, 1, 1),
        ],
        "timestamp timestamp_ntz, text string, sentiment_score double, likes bigint, retweets bigint",
    )
    import math

    first, second = sentiment.hourly_sentiment(posts).orderBy("hour").collect()
    assert (first["sentiment_score"], first["tweet_count"], first["likes"], first["retweets"]) == (0.25, 2, 15.0, 2.0)
    assert first["weighted_sentiment"] == pytest.approx(0.25 * math.log(15 + 2 + 2))
    assert second["sentiment_score"] == 0.0
    per_post = sentiment.hourly_sentiment(posts, level="post").orderBy("hour").first()
    assert per_post["weighted_sentiment"] == pytest.approx((math.log(12) - 0.5 * math.log(26)) / 2)


def test_text_classifier_learns(spark):
    rows = [(f"good fine {i}", 1.0) for i in range(30)] + [(f"bad poor {i}", 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "text string, label double")
    model = sentiment.fit_text_scorer(df)
    scores = sentiment.margin_scores(model, spark.createDataFrame([("good",), ("bad",)], "text string")).collect()
    assert scores[0]["sentiment_score"] > 0.3 > -0.3 > scores[1]["sentiment_score"]
