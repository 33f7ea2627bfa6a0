"""What-if scenarios: the last hours of every series with the newest hour overwritten."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volfuse.functions.scores import regime, weighted_sentiment
from volfuse.operators.dataset import MinMax, last_n, log_counts
from volfuse.operators.series import HOURLY, Series
from volfuse.schema import FEATURES, LOOKBACK, TARGET


@dataclass(frozen=True)
class Preset:
    """Values for the newest hour; None keeps what the data say. The price is given relative to it."""

    name: str
    close_factor: float = 1.0
    ret: float | None = None
    sentiment: float | None = None
    tweets: float | None = None
    likes: float | None = None
    retweets: float | None = None


# Close factor, return, sentiment, posts, likes, retweets.
PRESETS = [
    Preset("last_hour"),
    Preset("bull", 1.08, 0.065, 0.82, 5200, 16000, 4500),
    Preset("crash", 0.91, -0.09, -0.78, 7800, 22000, 8500),
    Preset("quiet", 1.0, 0.0, 0.05, 280, 650, 180),
]

# Lowest and highest input of each control (the price as a factor of the last close).
LIMITS = {
    "close_factor": (0.8, 1.2),
    "ret": (-0.1, 0.1),
    "sentiment": (-1.0, 1.0),
    "tweets": (0.0, 10000.0),
    "likes": (0.0, 50000.0),
    "retweets": (0.0, 25000.0),
}
WHOLE = {"tweets", "likes", "retweets"}  # controls that take whole numbers only
_INPUTS = {"ret": "return", "sentiment": "sentiment_score", "tweets": "tweet_count", "likes": "likes", "retweets": "retweets"}


def _preset_structs(presets) -> Column:
    def struct(p: Preset) -> Column:
        values = [F.lit(getattr(p, f)).cast("double").alias(f"to_{f}") for f in LIMITS]
        return F.struct(F.lit(p.name).alias("preset"), *values)

    return F.array(*[struct(p) for p in presets])


def clip(c: Column, name: str) -> Column:
    low, high = LIMITS[name]
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def clip_presets(df: DataFrame) -> DataFrame:
    """Hold every scenario input within the range its control allows; unset ones stay unset."""
    inputs = {f"to_{name}": name for name in LIMITS}
    return df.withColumns({c: F.when(F.col(c).isNotNull(), clip(F.col(c), name)) for c, name in inputs.items()})


def apply_scenarios(fused: DataFrame, presets=tuple(PRESETS), hours: int = LOOKBACK, spec: Series = HOURLY) -> DataFrame:
    """The last ``hours`` rows of every series, once per preset, with the newest row changed.

    Open, high and low follow the close; return, sentiment, counts and the weighted sentiment take the
    preset's values (clipped); all other columns are kept.
    """
    recent = last_n(fused.select(*spec.keys, spec.time, *FEATURES), hours, spec)
    newest = F.max(spec.time).over(Window.partitionBy(*spec.keys))  # `hours` rows per series
    copies = recent.withColumn("is_last", F.col(spec.time) == newest).select("*", F.inline(_preset_structs(presets)))
    copies = clip_presets(copies)
    last = F.col("is_last")
    factor = F.when(last, F.col("to_close_factor")).otherwise(1.0)
    changed = {c: F.col(c) * factor for c in ("open", "high", "low", "close")}
    for given, column in _INPUTS.items():
        current = F.col(column)
        if given in WHOLE:
            current = current.cast("bigint").cast("double")
        kept = clip(current, given)  # an untouched control still holds its range
        changed[column] = F.when(last, F.coalesce(F.col(f"to_{given}"), kept)).otherwise(F.col(column))
    rows = copies.withColumns(changed)
    weight = weighted_sentiment("sentiment_score", "likes", "retweets")
    rows = rows.withColumn("weighted_sentiment", F.when(last, weight).otherwise(F.col("weighted_sentiment")))
    return rows.select(*spec.keys, "preset", spec.time, "is_last", *FEATURES)


def scenario_windows(rows: DataFrame, scaler: MinMax, spec: Series = HOURLY) -> DataFrame:
    """One look-back window per series and preset, log-counted and scaled."""
    ready = scaler.transform(log_counts(rows), FEATURES)
    step = F.struct(spec.time, F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("values"))
    windows = ready.groupBy(*spec.keys, "preset").agg(F.sort_array(F.collect_list(step)).alias("_steps"))
    return windows.select(*spec.keys, "preset", F.col("_steps.values").alias("x"))


def score_scenarios(windows: DataFrame, scaler: MinMax, predictions: Mapping[str, Column]) -> DataFrame:
    """Predictions back on the target's own scale, each with its volatility band."""
    out = {}
    for name, value in predictions.items():
        out[name] = scaler.unscale(value, TARGET)
    scored = windows.withColumns(out)
    return scored.withColumns({f"{name}_regime": regime(name) for name in predictions})
