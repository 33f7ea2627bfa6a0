"""Raw trades or minute bars to regular bars with VWAP."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volfuse.operators.series import HOURLY, Series, fill_grid
from volfuse.session import require_utc
from volfuse.sources.columns import numeric_cols

OHLCV = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}
_ID_RANGE = Decimal(10**19)  # above every non-negative bigint
CARRIED = ["open", "high", "low", "close", "vwap"]


def rename_ohlcv(df: DataFrame) -> DataFrame:
    """Lower-case the five market columns that are present."""
    return df.withColumnsRenamed({old: new for old, new in OHLCV.items() if old in df.columns})


def floor_time(col: Column | str, width: str = "1 hour") -> Column:
    """Start of the bucket that holds the time; keeps the column's own timestamp type."""
    return F.window(col, width)["start"]


def first_order(ts: str, tie: str | None) -> Column:
    """Sort key for first and last within a bucket.

    With a tie-breaker, time and id are packed into one decimal: a struct would force a sort-based
    aggregate over all raw rows, a decimal keeps the hash-based one with its map-side combine. The
    time alone is cheaper still, so name a tie-breaker only where times can collide.
    """
    if tie is None:
        return F.col(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("decimal(19,0)")
    return micros * F.lit(_ID_RANGE) + F.col(tie).cast("decimal(19,0)")


def bar_inputs(ts: str = "ts", tie: str | None = None) -> dict[str, Column]:
    """Columns that ``bar_aggregates`` reads, computed once per row."""
    return {"_order": first_order(ts, tie)}


def bar_aggregates() -> list[Column]:
    """First, max, min, last, sum, as resampling does them: nulls are skipped, an empty sum is 0."""
    order = F.col("_order")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    return [
        F.min_by("open", F.when(F.col("open").isNotNull(), order)).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), order)).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.coalesce(F.sum(typical * F.col("volume")), F.lit(0.0)).alias("_tpv"),
    ]


def finish_bars(df: DataFrame) -> DataFrame:
    """VWAP from the two sums; a bar without volume takes its close."""
    vwap = F.coalesce(F.try_divide("_tpv", "volume"), F.col("close"))
    return df.withColumn("vwap", vwap).drop("_tpv")


def hourly_bars(
    df: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts", width: str = "1 hour", tie: str | None = None
) -> DataFrame:
    """One bar per key and bucket that has rows: open, high, low, close, volume, vwap.

    Rows without a key or a time are left out, as in any grouping by key.
    """
    require_utc(df)
    rows = df.na.drop("any", subset=[*keys, ts]).withColumns(bar_inputs(ts, tie))
    bucketed = rows.withColumn("hour", floor_time(ts, width))
    return finish_bars(bucketed.groupBy(*keys, "hour").agg(*bar_aggregates()))


def resample_mean(
    df: DataFrame, keys: Sequence[str] = ("symbol",), ts: str = "ts", width: str = "1 hour", out: str = "hour"
) -> DataFrame:
    """Mean of every numeric column per key and bucket."""
    values = [c for c in numeric_cols(df) if c not in keys]
    bucketed = df.withColumn(out, floor_time(ts, width))
    return bucketed.groupBy(*keys, out).agg(*[F.avg(c).alias(c) for c in values])


def fill_bars(bars: DataFrame, spec: Series = HOURLY) -> DataFrame:
    """Gap-free bars: prices and VWAP carried forward, volume 0 where nothing traded."""
    return fill_grid(bars, CARRIED, zero=["volume"], spec=spec)
