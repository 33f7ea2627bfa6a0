"""Small scalar rules: scores, weights, bands, number formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper ends of the low and the normal volatility band.
LOW_BELOW, HIGH_FROM = 0.005, 0.015


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def signed_score(label: Column | str, p: Column | str) -> Column:
    """Probability of the winning label, signed by it; neutral is 0."""
    name = F.lower(_col(label))
    return F.when(name.contains("pos"), _col(p)).when(name.contains("neg"), -_col(p)).otherwise(0.0)


def weighted_sentiment(score: Column | str, likes: Column | str, retweets: Column | str) -> Column:
    """Score scaled by the logarithm of its engagement."""
    return _col(score) * F.log1p(_col(likes) + _col(retweets) + 1.0)


def regime(c: Column | str, low: float = LOW_BELOW, high: float = HIGH_FROM) -> Column:
    c = _col(c)
    return F.when(c < low, "low").when(c < high, "normal").when(c.isNotNull(), "high")


def fixed(c: Column | str, digits: int = 6) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", _col(c))


def fmt_metrics(df: DataFrame, cols=("MAE", "RMSE", "R2"), digits: int = 6) -> DataFrame:
    return df.withColumns({c: fixed(c, digits) for c in cols})


def fmt_kpis(df: DataFrame) -> DataFrame:
    """The header figures as text: whole numbers with separators, the volatility as a percentage."""
    return df.select(
        F.format_number("active_hours", 0).alias("active_hours"),
        F.format_number("posts", 0).alias("posts"),
        fixed("mean_sentiment", 4).alias("mean_sentiment"),
        F.concat(fixed("mean_volatility_pct", 3), F.lit("%")).alias("mean_volatility_pct"),
    )
