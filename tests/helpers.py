"""Builders for small inputs."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

START = datetime(2024, 1, 1)

BAR_SCHEMA = "symbol string, ts timestamp_ntz, bar_id bigint, open double, high double, low double, close double, volume double"


def at(hours: float) -> datetime:
    return START + timedelta(hours=hours)


def trade(hour, bar_id, price, volume=1.0, symbol="a", **changes):
    row = {"open": price, "high": price, "low": price, "close": price, **changes}
    return (symbol, at(hour), bar_id, row["open"], row["high"], row["low"], row["close"], volume)


def trades(spark, *rows):
    return spark.createDataFrame(list(rows), BAR_SCHEMA)


def prices(spark, closes, symbol="a", first=0):
    """Gap-free hourly bars with the given closes."""
    rows = [
        (symbol, at(first + i), c, None if c is None else c + 1.0, None if c is None else c - 1.0, c, 1.0, c)
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(
        rows,
        "symbol string, hour timestamp_ntz, open double, high double, low double, close double, volume double, vwap double",
    )


def column(df, name, *order):
    order = order or ("hour",)
    return [r[0] for r in df.orderBy(*order).select(F.col(name)).collect()]
