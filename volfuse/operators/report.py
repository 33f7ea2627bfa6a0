"""The tables behind the report charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volfuse.functions.scores import regime
from volfuse.operators.bars import resample_mean
from volfuse.operators.evaluate import bounds
from volfuse.operators.indicators import moving_avg
from volfuse.operators.dataset import last_n, time_range
from volfuse.operators.series import DAILY, HOURLY, Series, fill_grid
from volfuse.session import stage


def daily_rollup(df: DataFrame, start=None, end=None, keys: Sequence[str] = ("symbol",), time: str = "hour") -> DataFrame:
    """Mean of every numeric column per day; days without rows are there, with nulls."""
    # One row for each day: written once, as filling reads it twice.
    means = stage(resample_mean(time_range(df, start, end, time), keys, time, "1 day", "day"), "days")
    return fill_grid(means, carry=[], spec=Series(tuple(keys), "day", DAILY.step))


def kpis(df: DataFrame) -> DataFrame:
    """The header figures of the report."""
    return df.agg(
        F.count("*").alias("active_hours"),
        F.sum("tweet_count").alias("posts"),
        F.avg("sentiment_score").alias("mean_sentiment"),
        (F.avg("future_volatility") * 100.0).alias("mean_volatility_pct"),
    )


def chart_price(daily: DataFrame) -> DataFrame:
    return daily.select("symbol", "day", "close", "bollinger_h", "bollinger_l")


def chart_vol_sentiment(daily: DataFrame) -> DataFrame:
    return daily.select("symbol", "day", "future_volatility", "sentiment_score")


def chart_posts(daily: DataFrame, days: int = 7) -> DataFrame:
    """Post volume beside the moving mean of the daily score."""
    smooth = moving_avg(daily, "sentiment_score", days, "sentiment_ma", DAILY)
    return smooth.select("symbol", "day", "tweet_count", "sentiment_score", "sentiment_ma")


def chart_predictions(predictions: DataFrame, n: int = 150, spec: Series = HOURLY) -> DataFrame:
    """The last ``n`` hours of every series."""
    return last_n(predictions, n, spec)


def prediction_bounds(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Ends of the diagonal in the actual-against-predicted chart."""
    return bounds(predictions, [actual, predicted])


def series(df: DataFrame, col: str, keys: Sequence[str] = ("symbol",), time: str = "hour") -> DataFrame:
    return df.select(*keys, time, col)


def regimes(df: DataFrame, col: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Hours spent in each volatility band."""
    return df.groupBy(*keys, regime(col).alias("regime")).agg(F.count("*").alias("hours"), F.avg(col).alias("mean"))
