import random

import pytest

from helpers import at, trade, trades
from volfuse.operators.bars import fill_bars, hourly_bars, resample_mean
from volfuse.operators.series import Series


def rows(df):
    return [r.asDict() for r in df.orderBy("symbol", "hour").collect()]


def test_empty_hour_carries_prices_and_has_no_volume(spark):
    bars = hourly_bars(trades(spark, trade(1 / 6, 1, 10.0, 2.0), trade(1 / 3, 2, 12.0, 4.0), trade(2.1, 3, 20.0, 1.0)))
    got = rows(fill_bars(bars))
    assert [r["hour"] for r in got] == [at(0), at(1), at(2)]
    assert [r["close"] for r in got] == [12.0, 12.0, 20.0]
    assert [r["open"] for r in got] == [10.0, 10.0, 20.0]
    assert [r["volume"] for r in got] == [6.0, 0.0, 1.0]
    assert got[1]["vwap"] == got[0]["vwap"] == pytest.approx((10 * 2 + 12 * 4) / 6)


def test_null_first_and_last_are_skipped(spark):
    bars = hourly_bars(
        trades(
            spark,
            trade(0.1, 1, 1.0, close=None, open=None),
            trade(0.2, 2, 2.0),
            trade(0.3, 3, 5.0),
            trade(0.4, 4, 9.0, close=None),
        )
    )
    (row,) = rows(bars)
    assert (row["open"], row["close"], row["high"], row["low"]) == (2.0, 5.0, 9.0, 1.0)


def test_all_closes_null_with_volume(spark):
    bars = hourly_bars(trades(spark, trade(0.1, 1, 4.0), trade(1.1, 2, 7.0, 3.0, close=None)))
    assert rows(bars)[1]["vwap"] == 0.0 and rows(bars)[1]["close"] is None
    filled = rows(fill_bars(bars))
    assert filled[1]["vwap"] == 0.0 and filled[1]["close"] == 4.0


def test_zero_volume_takes_the_close(spark):
    (row,) = rows(hourly_bars(trades(spark, trade(0.1, 1, 4.0, 0.0, close=3.5))))
    assert row["vwap"] == 3.5 and row["volume"] == 0.0


def test_missing_volume_counts_as_zero(spark):
    (row,) = rows(hourly_bars(trades(spark, trade(0.1, 1, 4.0, None))))
    assert row["volume"] == 0.0 and row["vwap"] == 4.0


def test_ties_go_to_the_lower_id(spark):
    tied = trades(spark, trade(0.1, 9, 3.0), trade(0.1, 2**62, 4.0), trade(0.1, 7, 5.0))
    (row,) = rows(hourly_bars(tied, tie="bar_id"))
    assert (row["open"], row["close"]) == (5.0, 4.0)


def test_input_order_does_not_matter(spark):
    feed = [trade(i / 7, i, 10.0 + i % 5, float(i % 3), symbol="ab"[i % 2]) for i in range(80)]
    shuffled = random.Random(1).sample(feed, len(feed))
    assert rows(hourly_bars(trades(spark, *feed))) == rows(hourly_bars(trades(spark, *shuffled)))


def test_rows_without_key_or_time_are_left_out(spark):
    feed = [trade(0.1, 1, 4.0), trade(0.1, 2, 9.0, symbol=None), ("a", None, 3, 1.0, 1.0, 1.0, 1.0, 1.0)]
    (row,) = rows(hourly_bars(trades(spark, *feed)))
    assert row["high"] == 4.0


def test_mean_resample_covers_all_numbers(spark):
    mean = resample_mean(trades(spark, trade(0.1, 2, 4.0), trade(0.2, 4, 6.0, close=None)))
    (row,) = rows(mean)
    assert (row["bar_id"], row["open"], row["close"]) == (3.0, 5.0, 4.0)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_gaps_longer_than_a_block(spark, block):
    bars = hourly_bars(trades(spark, trade(0.5, 1, 1.0), trade(1.5, 2, 2.0, close=None), trade(11.5, 3, 3.0)))
    got = rows(fill_bars(bars, Series(rows=block)))
    assert [r["close"] for r in got] == [1.0] * 11 + [3.0]
    assert [r["hour"] for r in got] == [at(i) for i in range(12)]


def test_other_zones_are_refused(spark):
    feed = trades(spark, trade(0.5, 1, 1.0))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Istanbul")
    try:
        with pytest.raises(ValueError, match="timeZone"):
            hourly_bars(feed)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_long_gap_is_dealt_out(spark):
    """Fifty years between two bars: many tasks make the hours in between, none more than some blocks."""
    from collections import Counter
    from datetime import datetime

    from pyspark.sql import functions as F
    from volfuse.operators.series import fill_grid

    rows = [("a", datetime(1970, 1, 1), 1.0), ("a", datetime(2020, 1, 1), 2.0), ("b", datetime(2020, 1, 1), 3.0)]
    df = spark.createDataFrame(rows, "symbol string, hour timestamp_ntz, close double")
    out = fill_grid(df, ["close"])
    tasks = Counter(r[0] for r in out.groupBy(F.spark_partition_id()).count().collect())
    facts = out.groupBy("symbol").agg(F.count("*"), F.min("close"), F.max("close"), F.countDistinct("hour")).orderBy("symbol").collect()
    assert [tuple(r) for r in facts] == [("a", 438289, 1.0, 2.0, 438289), ("b", 1, 3.0, 3.0, 1)]
    assert len(tasks) > 1
