"""Metrics, blending and comparison of forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volfuse.operators.dataset import union_all

# Fixed value: share of the convolutional model in the stored ensemble.
ENSEMBLE_WEIGHT = 0.88


def blend(a: Column | str, b: Column | str, w: float | Column = ENSEMBLE_WEIGHT) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    w = w if isinstance(w, Column) else F.lit(w)
    return w * a + (F.lit(1.0) - w) * b


def _metric_columns(y: str, pred: str) -> list[Column]:
    error = F.col(pred) - F.col(y)
    sse, sst = F.sum(error * error), F.regr_syy(y, y)
    r2 = F.when(sst > 0, 1.0 - sse / sst).when(sse == 0, 1.0).otherwise(0.0)
    return [
        F.avg(F.abs(error)).alias("MAE"),
        F.sqrt(F.avg(error * error)).alias("RMSE"),
        r2.alias("R2"),
    ]


def regression_metrics(df: DataFrame, y: str, predictions: Mapping[str, str]) -> DataFrame:
    """MAE, RMSE and R2 of every named prediction column, all in one pass."""
    named = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("pred")) for m, c in predictions.items()])
    long = df.select(F.col(y).alias("y"), F.inline(named))
    return long.groupBy("model").agg(*_metric_columns("y", "pred"))


def blend_search(df: DataFrame, y: str, a: str, b: str, steps: int = 100) -> DataFrame:
    """RMSE of w*a + (1-w)*b for w = 0, 1/steps, .. 1.

    The squared error is quadratic in w, so three sums over the data give the whole curve.
    """
    gap, rest = F.col(a) - F.col(b), F.col(b) - F.col(y)
    sums = df.agg(
        F.avg(gap * gap).alias("_gg"), F.avg(gap * rest).alias("_gr"), F.avg(rest * rest).alias("_rr")
    )
    w = F.col("w")
    mse = w * w * F.col("_gg") + 2.0 * w * F.col("_gr") + F.col("_rr")
    curve = sums.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    curve = curve.withColumn("w", F.col("_step") / F.lit(float(steps)))
    return curve.select("w", F.sqrt(F.greatest(mse, F.lit(0.0))).alias("rmse"))


def best_weight(curve: DataFrame) -> float:
    """The smallest weight with the lowest error."""
    return curve.agg(F.min_by("w", F.struct("rmse", "w")).alias("w")).first()["w"]


def best_blend(df: DataFrame, y: str, a: str, b: str, fit_on: Column | None = None, steps: int = 100) -> DataFrame:
    """Metrics of the best blend. The weight is searched on all given rows, which are the test rows in
    the usual call; ``fit_on`` restricts the search to other rows, and the metrics to the rest."""
    searched = df if fit_on is None else df.filter(fit_on)
    measured = df if fit_on is None else df.filter(~fit_on)
    w = best_weight(blend_search(searched, y, a, b, steps))
    blended = measured.withColumn("_blend", blend(a, b, w))
    return blended.agg(*_metric_columns(y, "_blend")).select(
        F.lit(f"Ensemble_Blend (w={w:.2f})").alias("model"), F.lit(w).alias("w"), "MAE", "RMSE", "R2"
    )


def _rank() -> list[Column]:
    """Lowest RMSE first. Sums over many rows differ in their last digits from run to run, so errors
    that agree in nine decimals are equal and the earlier row wins."""
    return [F.round("RMSE", 9)]


def leaderboard(results: Sequence[DataFrame]) -> DataFrame:
    """All result tables in the given order, with the first row of lowest RMSE marked as best."""
    ranked = [
        df.select(F.lit(i).alias("source"), "model", "MAE", "RMSE", "R2")
        for i, df in enumerate(results)
    ]
    table = union_all(ranked)
    everything = Window.partitionBy()  # one row per model: a handful
    order = F.struct(*_rank(), "source", "model")
    return table.withColumn("best", order == F.min(order).over(everything))


def best_model(results: DataFrame) -> DataFrame:
    """Name and RMSE of the first model with the lowest RMSE."""
    order = F.struct(*_rank(), *[c for c in ("source",) if c in results.columns], "model")
    return results.agg(F.min_by("model", order).alias("model"), F.min("RMSE").alias("RMSE"))


def bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lowest and highest value over several columns together."""
    low = [F.min(c) for c in cols]
    high = [F.max(c) for c in cols]
    return df.agg(
        (F.least(*low) if len(cols) > 1 else low[0]).alias("low"),
        (F.greatest(*high) if len(cols) > 1 else high[0]).alias("high"),
    )
