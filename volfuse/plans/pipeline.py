"""The steps from the given tables to predictions, as DataFrames.

Steps whose result several later steps read are staged: written once to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volfuse.operators import dataset, evaluate, models, sentiment
from volfuse.operators.bars import fill_bars, hourly_bars
from volfuse.operators.dataset import MinMax
from volfuse.operators.fusion import fuse
from volfuse.operators.indicators import price_features
from volfuse.operators.series import number_rows, to_panel
from volfuse.schema import FEATURES, TARGET
from volfuse.session import stage, stage_all
from volfuse.sources import fixtures

def bars(spark: SparkSession, d: str) -> DataFrame:
    return hourly_bars(fixtures.bars_raw(spark, d), tie="bar_id")


def filled(spark: SparkSession, d: str) -> DataFrame:
    return fill_bars(bars(spark, d))


def features(spark: SparkSession, d: str) -> DataFrame:
    return price_features(filled(spark, d))


def posts(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.clean_posts(fixtures.posts_raw(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.lexicon_scorer(posts(spark, d))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return sentiment.hourly_sentiment(scored(spark, d))


def fused(spark: SparkSession, d: str) -> DataFrame:
    return fuse(*stage_all(features=features(spark, d), sentiment=hourly(spark, d)))


def matrix(spark: SparkSession, d: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return dataset.model_matrix(fused(spark, d), start, end)


@dataclass
class Prepared:
    """The model matrix on disk with its split and the ranges of its training rows."""

    matrix: DataFrame
    split: DataFrame
    scaler: MinMax

    @property
    def scaled(self) -> DataFrame:
        return self.scaler.transform(self.split)


def prepared(spark: SparkSession, d: str) -> Prepared:
    return prepare(fused(spark, d))


def prepare(fused_table: DataFrame) -> Prepared:
    table = stage(dataset.model_matrix(fused_table), "matrix")
    split = dataset.time_split(table)
    scaler = MinMax.fit(split.filter("split = 'train'"), [*FEATURES, TARGET])
    return Prepared(table, split, scaler)


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Two forecasters without parameters: the previous label, and the mean of the last 24."""
    labels = stage(features(spark, d).select("symbol", "hour", F.col(TARGET).alias("actual")), "labels")
    panel = to_panel(number_rows(labels), before=24, index=F.col("rn"))
    day = panel.frame(-24, -1)
    panel = panel.add(
        previous=F.lag("actual").over(panel.window),
        mean24=F.when(F.count("actual").over(day) == 24, F.avg("actual").over(day)),
    )
    return panel.home().drop("rn", "n").na.drop()


# --- fitted models ----------------------------------------------------------------------------


def row_models(p: Prepared, trees: int = 100) -> tuple[Model, Model, DataFrame]:
    """Least squares and forest on scaled rows; the last value is the test rows with both predictions."""
    ready = stage(models.assemble(p.scaler.transform(p.split, FEATURES)), "model-rows")
    train, test = ready.filter("split = 'train'"), ready.filter("split = 'test'")
    linear, forest = models.fit_linear(train), models.fit_forest(train, trees=trees)
    return linear, forest, forest.transform(linear.transform(test))


def scaled_sequences(p: Prepared) -> DataFrame:
    """Look-back sequences of scaled features with the scaled target as label."""
    return dataset.sequences(p.scaler.transform(p.matrix), share=0.8)


def prediction_table(p: Prepared, forest: Model | None = None) -> DataFrame:
    """One row per test sequence: time, actual value and one column per model, on the target's scale.

    The least squares model learns from the newest step of each training sequence; a missing forest
    predicts 0; the blend weight is the best one on these rows.
    """
    seq = stage(scaled_sequences(p), "sequences")
    flat = models.assemble(dataset.last_step(seq)).withColumn("actual", p.scaler.unscale(F.col("label"), TARGET))
    linear = models.fit_linear(flat.filter("split = 'train'"), label="actual")
    test = linear.transform(flat.filter("split = 'test'"))
    test = forest.transform(test) if forest is not None else test.withColumn("RandomForest", F.lit(0.0))
    test = stage(test.select("symbol", "label_ts", "actual", "LinearRegression", "RandomForest"), "predictions")
    w = evaluate.best_weight(evaluate.blend_search(test, "actual", "RandomForest", "LinearRegression"))
    return test.withColumn("Ensemble", evaluate.blend("RandomForest", "LinearRegression", w))
