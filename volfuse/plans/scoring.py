"""Forecasters fitted once, stored with their scaler, and applied by later runs that fit nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.regression import LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volfuse.operators import evaluate, models
from volfuse.operators.dataset import MinMax
from volfuse.plans.pipeline import Prepared
from volfuse.schema import FEATURES, TARGET
from volfuse.session import stage
from volfuse.sources import tables

LINEAR, FOREST, BLEND = "LinearRegression", "RandomForest", "Ensemble"
_BLEND = "weight double"


@dataclass(frozen=True)
class Stored:
    """What a training run leaves: ranges, least squares, and perhaps a forest with its share of the blend."""

    scaler: MinMax
    linear: Model
    forest: Model | None = None
    weight: float | None = None

    @property
    def columns(self) -> list[str]:
        return [LINEAR] if self.forest is None else [LINEAR, FOREST, BLEND]

    def predict(self, scaled: DataFrame) -> DataFrame:
        """Rows of scaled features with a column for each model, on the scaled target; one pass, nothing is fitted."""
        out = self.linear.transform(models.assemble(scaled, out="_features"))
        if self.forest is not None:
            out = self.forest.transform(out).withColumn(BLEND, evaluate.blend(FOREST, LINEAR, self.weight))
        return out.drop("_features")

    def forecast(self, matrix: DataFrame) -> DataFrame:
        """Rows of the model matrix with a column for each model, on the target's own scale; inputs stay as they are."""
        kept = F.struct(*[F.col(f"`{c}`") for c in matrix.columns]).alias("_given")
        scaled = self.scaler.transform(matrix.select(kept, *FEATURES), FEATURES)
        own = self.scaler.inverse(self.predict(scaled), {c: TARGET for c in self.columns})
        return own.select("_given.*", *self.columns)


def train(p: Prepared, path: str, trees: int | None = 100) -> None:
    """Fit on the training rows and store everything below ``path``; ``trees=None`` leaves the forest out.

    As in the prediction table, the forest's share is the best one on the test rows.
    """
    spark = p.matrix.sparkSession
    ready = stage(models.assemble(p.scaled, out="_features"), "training")
    rows, test = ready.filter("split = 'train'"), ready.filter("split = 'test'")
    linear = models.fit_linear(rows, features="_features", out=LINEAR)
    p.scaler.save(spark, f"{path}/scaler")
    models.save_model(linear, f"{path}/linear")
    if trees is None:
        return
    forest = models.fit_forest(rows, features="_features", out=FOREST, trees=trees)
    weight = evaluate.best_weight(evaluate.blend_search(forest.transform(linear.transform(test)), TARGET, FOREST, LINEAR))
    models.save_model(forest, f"{path}/forest")
    tables.write_table(spark.createDataFrame([(weight,)], _BLEND), f"{path}/blend")


def load(spark: SparkSession, path: str) -> Stored:
    """The stored models; a folder without scaler or least squares raises, one without a forest does not."""
    tables.require(spark, f"{path}/scaler", f"{path}/linear")
    scaler, linear = MinMax.load(spark, f"{path}/scaler"), models.load_model(LinearRegressionModel, f"{path}/linear")
    try:
        tables.require(spark, f"{path}/blend", f"{path}/forest")
    except FileNotFoundError:
        return Stored(scaler, linear)
    weight = spark.read.schema(_BLEND).parquet(f"{path}/blend").first()["weight"]
    return Stored(scaler, linear, models.load_model(RandomForestRegressionModel, f"{path}/forest"), weight)
