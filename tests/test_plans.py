"""Shape of the physical plans: how often data are scanned and shuffled, and what never happens."""

import re

import pytest
from pyspark.sql import functions as F

from helpers import prices
from volfuse.operators import dataset, evaluate, indicators, report, sentiment
from volfuse.operators.bars import fill_bars, hourly_bars
from volfuse.operators.fusion import fuse
from volfuse.operators.series import Series, ffill, number_rows
from volfuse.plans import pipeline
from volfuse.session import stage
from volfuse.sources import fixtures

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ran(df):
    """The plan that was really executed, after run-time changes."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture()
def large(spark):
    """Plan as for data too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_bars_combine_before_the_shuffle(spark):
    text = plan(hourly_bars(fixtures.bars_raw(spark, SF), tie="bar_id"))
    assert text.count("Exchange hashpartitioning(symbol") == 1 and "partial_min_by" in text
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_key_filters_reach_the_scan(spark):
    one = pipeline.filled(spark, SF).filter("symbol = 'click'")
    assert "EqualTo(event_type,click)" in plan(one)
    narrow = plan(hourly_bars(fixtures.bars_raw(spark, SF)).select("symbol", "hour", "high"))
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>", narrow)


def scans(df):
    """Names of the staged tables that a plan reads; of others, the last part of their path."""
    return sorted(re.sub(r"-[0-9a-f]{32}$", "", p.rsplit("/", 1)[1]) for p in re.findall(r"paths\)\[([^\],]+)", ran(df)))


def test_bars_scan_the_trades_once(spark, large):
    text = ran(pipeline.filled(spark, SF))
    assert text.count("FileScan") == 1 and text.count("ReusedExchange") == 1


def test_features_read_staged_rows(spark, large):
    """Continuing the scans reads the indicator rows, for block summaries and for the rows, but not the trades."""
    assert set(scans(pipeline.features(spark, SF))) == {"scans"}


def test_indicators_take_one_shuffle(spark):
    bars = stage(prices(spark, [float(i % 9) for i in range(300)]), "bars")
    for df, windows in ((indicators.atr(bars), 2), (indicators.macd(bars), 3)):
        text = plan(df)
        assert text.count("Exchange hashpartitioning") == 1 and text.count("+- Sort") == 1
        assert text.count("Window [") == windows


def test_no_window_holds_a_whole_series(spark, large):
    """Windows over rows are keyed by block; windows keyed by symbol alone see one row per block."""
    bars = stage(prices(spark, [float(i % 9) for i in range(300)]), "bars")
    for df in (fill_bars(bars), ffill(bars, ["close"]), number_rows(bars), dataset.sequences(bars, ["close"], "close")):
        text = plan(df)
        for spec in re.findall(r"\], \[([^\]]*)\], \[[^\]]*\]\n", text):
            assert "_block" in spec or "symbol" in spec
        assert "SinglePartition" not in text
        assert len(re.findall(r"Window \[[^\n]*\], \[symbol#\d+\]", text)) <= len(re.findall("HashAggregate", text))


def test_last_rows_are_cut_before_the_shuffle(spark):
    text = plan(dataset.last_n(stage(prices(spark, [1.0, 2.0]), "bars"), 1))
    below = text[text.index("Exchange") :]
    assert "WindowGroupLimit" in below


def test_text_is_cleaned_once_and_in_python_only_for_entities(spark):
    cleaned = sentiment.clean_posts(fixtures.posts_raw(spark, SF))
    assert plan(cleaned).count("ArrowEvalPython") == 1 and plan(cleaned).count("(?U)http") == 1
    scored = sentiment.lexicon_scorer(sentiment.clean_posts(fixtures.posts_raw(spark, SF), entities=False))
    assert "Python" not in plan(sentiment.hourly_sentiment(scored))


def test_metrics_of_all_models_take_one_scan(spark):
    df = stage(spark.range(100).select((F.col("id") * 1.0).alias("y"), F.rand(1).alias("a"), F.rand(2).alias("b")), "p")
    assert plan(evaluate.regression_metrics(df, "y", {"A": "a", "B": "b"})).count("FileScan") == 1
    assert plan(evaluate.blend_search(df, "y", "a", "b")).count("FileScan") == 1


def test_fusion_joins_once(spark, large):
    """The joined hours are written once; what is read from them is read for the rows and for the block ends."""
    assert scans(pipeline.fused(spark, SF)) == ["merged", "merged"]
    assert scans(report.daily_rollup(pipeline.fused(spark, SF))) == ["days", "days"]


def test_first_rows_are_not_copied(spark, monkeypatch):
    """The result is a filter below the cleaning, so only the texts of the first rows are cleaned for it."""
    monkeypatch.setattr("volfuse.session.stage_path", lambda *_: pytest.fail("a copy was written"))
    text = plan(dataset.first_n(pipeline.posts(spark, SF).select("post_id", "timestamp", "text"), 50))
    assert text.count("FileScan") == 1 and text.count("ArrowEvalPython") == 1 and "Window" not in text
    cleaning, cut = text.index("ArrowEvalPython"), [m.start() for m in re.finditer("2023-12-31|2024-01", text)]
    assert cut and max(cut) > cleaning  # children follow their parents


def test_fusion_has_no_cross_join(spark, large):
    price = stage(prices(spark, [1.0] * 50), "price")
    index = stage(price.select("hour", F.lit(0.5).alias("sentiment_score"), F.lit(1).alias("tweet_count")), "index")
    text = plan(fuse(price, index, Series(rows=16)))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text


def test_no_query_needs_a_cross_join(spark):
    for df in (pipeline.fused(spark, SF), pipeline.forecasts(spark, SF), dataset.time_split(pipeline.matrix(spark, SF))):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text
