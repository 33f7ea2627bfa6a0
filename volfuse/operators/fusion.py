"""Price features and the sentiment index on one time axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volfuse.functions.scores import weighted_sentiment
from volfuse.operators.series import HOURLY, Series, ffill
from volfuse.session import stage

CARRIED = ["sentiment_score", "weighted_sentiment"]
WEIGHED = ["sentiment_score", "likes", "retweets"]
COUNTED = ["tweet_count", "likes", "retweets"]


def within_range_of(df: DataFrame, other: DataFrame, time: str = "hour") -> DataFrame:
    """Rows between the first and the last time of another table, both included.

    The bounds are a scalar subquery: it runs first and its values filter the rows, without a join.
    """
    ends = other.select(F.struct(F.min(time).alias("first"), F.max(time).alias("last"))).scalar()
    return df.filter((F.col(time) >= ends["first"]) & (F.col(time) <= ends["last"]))


def days_of(df: DataFrame, other: DataFrame, time: str = "hour", day: str = "day") -> DataFrame:
    """Rows of the days from the first to the last time of another table, both included.

    On a table stored by ``day`` the bounds, a scalar subquery, select its partitions before anything is read.
    Rows without a day belong to no day and go.
    """
    ends = other.select(F.struct(F.to_date(F.min(time)).alias("first"), F.to_date(F.max(time)).alias("last"))).scalar()
    return df.filter((F.col(day) >= ends["first"]) & (F.col(day) <= ends["last"]))


def _default(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)


def fuse(price: DataFrame, sentiment: DataFrame, spec: Series = HOURLY, max_age: int | None = None) -> DataFrame:
    """Every price row with the sentiment of its hour.

    Scores last until the next ones (``max_age`` limits that, in steps); counts do not, they are 0 in
    hours without posts. A sentiment column that the price table has too gets the suffix ``_sent``.
    The engagement weight is added unless the sentiment table brings its own.
    """
    if "weighted_sentiment" not in sentiment.columns and set(WEIGHED) <= set(sentiment.columns):
        sentiment = sentiment.withColumn("weighted_sentiment", weighted_sentiment(*WEIGHED))
    clashes = {c: f"{c}_sent" for c in sentiment.columns if c in price.columns and c != spec.time}
    side = sentiment.withColumnsRenamed(clashes)
    if max_age is not None:
        side = side.withColumn("_known_at", F.col(spec.time))
    # Written once: the carry-forward reads it twice, the second time a few columns only.
    merged = stage(price.na.drop("any", subset=[*spec.keys, spec.time]).join(side, spec.time, "left"), "merged")
    carried = [c for c in CARRIED if c in merged.columns]
    marks = ["_known_at"] if max_age is not None else []
    merged = ffill(merged, carried + marks, spec)
    if max_age is not None:
        age = F.unix_seconds(F.col(spec.time).cast("timestamp")) - F.unix_seconds(F.col("_known_at").cast("timestamp"))
        merged = merged.withColumns({c: F.when(age <= max_age * spec.step, F.col(c)) for c in carried}).drop("_known_at")
    fused = merged.withColumns({c: _default(merged, c).cast("double") for c in [*CARRIED, *COUNTED]})
    given = [*price.columns, *[c for c in side.columns if c not in (spec.time, "_known_at")]]
    return fused.select(*given, *[c for c in (*CARRIED, *COUNTED) if c not in given])


def match_count(fused: DataFrame) -> DataFrame:
    """How many rows there are, and how many met at least one post."""
    return fused.agg(F.count("*").alias("n_rows"), F.count_if(F.col("tweet_count") > 0).alias("n_matched"))
