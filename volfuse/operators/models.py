"""Forecasters on MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volfuse.operators.series import HOURLY, Series
from volfuse.schema import FEATURES, IMPORTANCES, TARGET


def assemble(df: DataFrame, cols: Sequence[str] = FEATURES, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def fit_linear(train: DataFrame, label: str = TARGET, features: str = "features", out: str = "LinearRegression") -> Model:
    """Ordinary least squares through one pass of summed cross products."""
    return LinearRegression(
        featuresCol=features, labelCol=label, predictionCol=out, solver="normal", regParam=0.0
    ).fit(train)


def fit_linear_by_series(train: DataFrame, cols: Sequence[str], label: str = TARGET, spec: Series = HOURLY) -> DataFrame:
    """Ordinary least squares of every series: keys, ``n``, ``coefficients`` in the order of ``cols``, ``intercept``.

    One aggregate gives means and centred cross products of all pairs of columns; they merge before the shuffle, so a
    series of any length arrives as one row per task. Each series is then solved from its one row. Rows with a null
    take no part; columns that don't vary, or repeat others, share the smallest coefficients that fit. Meant for a few
    columns: the aggregate has a product for each pair of them.
    """
    names = [*cols, label]
    pairs = [(i, j) for j in range(len(names)) for i in range(j + 1) if i < len(cols)]
    rows = train.select(*spec.keys, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(names)]).na.drop()
    means = F.array(*[F.avg(f"_{i}") for i in range(len(names))]).alias("means")
    products = F.array(*[F.covar_pop(f"_{i}", f"_{j}") for i, j in pairs]).alias("products")
    sums = rows.groupBy(*spec.keys).agg(F.count("*").alias("n"), means, products)
    keys = [f"{f.name} {f.dataType.simpleString()}" for f in train.select(*spec.keys).schema]
    return sums.mapInPandas(_solver(len(cols), pairs), ", ".join([*keys, "n bigint", "coefficients array<double>", "intercept double"]))


def _solver(width: int, pairs: Sequence[tuple[int, int]]):
    def solve(batches):
        import numpy as np

        at = np.array(pairs)
        for batch in batches:
            weights, intercepts = [], []
            for means, products in zip(batch.pop("means"), batch.pop("products"), strict=True):
                full = np.zeros((width + 1, width + 1))
                full[at[:, 0], at[:, 1]] = full[at[:, 1], at[:, 0]] = products
                spread = np.sqrt(np.diag(full)[:width])
                spread[spread == 0] = 1.0
                scaled = full[:width, :width] / np.outer(spread, spread)
                w = np.linalg.lstsq(scaled, full[:width, width] / spread, rcond=1e-12)[0] / spread
                weights.append(w.tolist())
                intercepts.append(float(means[width] - w @ np.asarray(means[:width])))
            yield batch.assign(coefficients=weights, intercept=intercepts)

    return solve


def fit_forest(
    train: DataFrame,
    label: str = TARGET,
    features: str = "features",
    out: str = "RandomForest",
    trees: int = 100,
    depth: int = 30,
    seed: int = 42,
) -> Model:
    """Random forest in which every split may use every feature. Trees grow to ``depth``, at most the 30 that the library allows."""
    return RandomForestRegressor(
        featuresCol=features, labelCol=label, predictionCol=out, numTrees=trees, maxDepth=depth, seed=seed,
        featureSubsetStrategy="all", maxMemoryInMB=1024, cacheNodeIds=True,
    ).fit(train)


def importances(model: Model, df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """One row per feature, most important first; ``df`` only lends its session."""
    rows = [(c, float(v)) for c, v in zip(cols, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, IMPORTANCES).orderBy(F.col("importance").desc())


def flatten_steps(seq: DataFrame, out: str = "lagged") -> DataFrame:
    """All steps of a sequence side by side as one feature vector."""
    return seq.withColumn(out, array_to_vector(F.flatten("x")))


def fit_lagged(train: DataFrame, algo: str = "linear", label: str = "label", out: str = "Lagged") -> Model:
    """Regressor over whole look-back windows (``flatten_steps`` first)."""
    shared = {"featuresCol": "lagged", "labelCol": label, "predictionCol": out}
    if algo == "linear":
        return LinearRegression(**shared, regParam=0.01, elasticNetParam=0.5, maxIter=50).fit(train)
    if algo == "gbt":
        return GBTRegressor(**shared, maxIter=20, maxDepth=4, seed=42).fit(train)
    raise ValueError(f"unknown algorithm {algo!r}")


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type[Model], path: str) -> Model:
    return kind.load(path)

