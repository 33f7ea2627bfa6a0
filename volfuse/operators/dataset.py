"""From the fused table to model inputs: ranges, samples, splits, scaling, look-back sequences."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volfuse.functions.casts import finite_columns
from volfuse.operators.series import HOURLY, Series, number_rows, to_panel
from volfuse.schema import COUNT_FEATURES, FEATURES, LOOKBACK, SCALER, TARGET
from volfuse.sources.tables import read_table, write_table

# --- filters ----------------------------------------------------------------------------------


def time_range(df: DataFrame, start=None, end=None, time: str = "hour") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; a missing end leaves that side open."""
    for bound, keep in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            df = df.filter(getattr(F.col(time), keep)(F.to_timestamp_ntz(F.lit(str(bound)))))
    return df


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def project(df: DataFrame, cols: Iterable[str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """The listed columns that exist; those with a default are added when missing."""
    defaults = defaults or {}
    picked = [F.col(c) if c in df.columns else F.lit(defaults[c]).alias(c) for c in cols if c in df.columns or c in defaults]
    return df.select(*picked)


def log_counts(df: DataFrame, cols: Iterable[str] = COUNT_FEATURES) -> DataFrame:
    return df.withColumns({c: F.log1p(c) for c in cols if c in df.columns})


def model_matrix(fused: DataFrame, start=None, end=None, spec: Series = HOURLY) -> DataFrame:
    """Complete rows of the range with the features in their fixed order, counts on a log scale."""
    inside = time_range(fused, start, end, spec.time)
    return log_counts(drop_incomplete(finite_columns(project(inside, [*spec.keys, spec.time, *FEATURES, TARGET]))))


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several tables, matched by column name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


# --- first and last rows ----------------------------------------------------------------------


def _cell_of(rows: DataFrame, cell: Column, n: int) -> tuple[object, int] | None:
    """The cell that holds row ``n`` in order of cells, a null cell last, and how many of its rows belong to the
    first ``n``; None where there are not ``n`` rows."""
    counts = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    so_far = Window.orderBy(F.col("cell").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)  # one row a cell
    place = counts.withColumn("upto", F.sum("n").over(so_far)).where(F.col("upto") >= n)
    at = place.agg(F.min_by(F.struct("cell", "n", "upto"), "upto").alias("at")).first()["at"]
    return at and (at["cell"], n - (at["upto"] - at["n"]))


def first_n(df: DataFrame, n: int, order: tuple[str, str] = ("timestamp", "post_id")) -> DataFrame:
    """The first ``n`` rows by time, then id (unique); rows without a time come last.

    Nothing is copied: the result is a filter on the rows as they are. Counts per hour name the hour that holds
    row ``n``, counts per second the second within it; of that second's rows, or of those without a time, the two
    key columns of the first ones are ordered to find the key to cut at. Each look reads only the hour or second
    that the one before has named, and no column but the keys; ``df`` has to give the same rows each time.
    """
    time, ident = order
    if n <= 0:
        return df.limit(0)
    inside, left = df.select(time, ident), n
    for unit in ("hour", "second"):
        cell = F.date_trunc(unit, time)
        found = _cell_of(inside.select(time), cell, left)
        if found is None:
            return df
        at, left = found
        inside = inside.where(F.col(time).isNull() if at is None else cell == F.lit(at))
        if at is None:
            break
    first = inside.orderBy(F.col(time), F.col(ident)).limit(left)
    cut = first.agg(F.max(F.struct(F.col(time), F.col(ident))).alias("cut")).select("cut.*")
    cut = cut.select(F.col(time).cast("string").alias("at"), F.col(ident).alias("id")).first()
    same_or_earlier = F.col(ident) <= cut["id"]
    if cut["at"] is None:
        return df.filter(F.col(time).isNotNull() | same_or_earlier)
    moment = F.lit(cut["at"]).cast(df.schema[time].dataType)
    return df.filter((F.col(time) < moment) | ((F.col(time) == moment) & same_or_earlier))


def last_n(df: DataFrame, n: int, spec: Series = HOURLY) -> DataFrame:
    """The last ``n`` rows of every series; tasks keep at most ``n`` rows per series before the shuffle."""
    latest = Window.partitionBy(*spec.keys).orderBy(F.col(spec.time).desc())
    return df.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= n).drop("_back")


def top_k(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    return df.orderBy(F.col(col).desc()).limit(k)


# --- splits -----------------------------------------------------------------------------------


def time_split(df: DataFrame, share: float = 0.8, spec: Series = HOURLY, embargo: int = 0) -> DataFrame:
    """Mark the first part of every series ``train`` and the rest ``test``, without shuffling rows.

    ``embargo`` rows before the cut are marked ``embargo``; with the label's horizon, no training
    label reaches into the test rows.
    """
    cut = F.floor(F.col("_n") * F.lit(share))
    part = F.when(F.col("_rn") > cut, "test").when(F.col("_rn") > cut - embargo, "embargo").otherwise("train")
    return number_rows(df, spec, "_rn", "_n").withColumn("split", part).drop("_rn", "_n")


def split_bounds(df: DataFrame, share: float = 0.8, spec: Series = HOURLY) -> DataFrame:
    """Sizes and limits of both parts per series."""
    train, test = F.col("split") == "train", F.col("split") == "test"
    time = F.col(spec.time)
    return (
        time_split(df, share, spec)
        .groupBy(*spec.keys)
        .agg(
            F.count_if(train).alias("n_train"),
            F.count_if(test).alias("n_test"),
            F.max(F.when(train, time)).alias("train_end"),
            F.min(F.when(test, time)).alias("test_start"),
            F.max(F.when(test, time)).alias("test_end"),
        )
    )


# --- scaling ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class MinMax:
    """Column ranges seen in training; other values may leave 0..1 and are not clipped."""

    low: Mapping[str, float]
    high: Mapping[str, float]

    @classmethod
    def fit(cls, train: DataFrame, cols: Sequence[str]) -> MinMax:
        seen = train.agg(*[F.min(c).alias(f"low_{c}") for c in cols], *[F.max(c).alias(f"high_{c}") for c in cols]).first()
        if empty := [c for c in cols if seen[f"low_{c}"] is None]:
            raise ValueError(f"no training row has a value in {', '.join(empty)}")
        return cls({c: seen[f"low_{c}"] for c in cols}, {c: seen[f"high_{c}"] for c in cols})

    def _width(self, col: str) -> float:
        return (self.high[col] - self.low[col]) or 1.0  # a constant column becomes 0

    def scale(self, value: Column, col: str) -> Column:
        return (value - F.lit(self.low[col])) / F.lit(self._width(col))

    def unscale(self, value: Column, col: str) -> Column:
        return value * F.lit(self._width(col)) + F.lit(self.low[col])

    def transform(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        return df.withColumns({c: self.scale(F.col(c), c) for c in (cols or self.low) if c in df.columns})

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(c, float(self.low[c]), float(self.high[c])) for c in self.low]
        write_table(spark.createDataFrame(rows, SCALER), path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MinMax:
        rows = read_table(spark, path, SCALER, "parquet").collect()  # one row per column
        return cls({r["column"]: r["low"] for r in rows}, {r["column"]: r["high"] for r in rows})

    def inverse(self, df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
        """``cols`` maps a scaled column to the column whose range it was scaled with."""
        return df.withColumns({c: self.unscale(F.col(c), source) for c, source in cols.items()})


# --- sequences --------------------------------------------------------------------------------


def sequences(
    df: DataFrame,
    cols: Sequence[str] = FEATURES,
    target: str = TARGET,
    steps: int = LOOKBACK,
    spec: Series = HOURLY,
    share: float | None = None,
) -> DataFrame:
    """For every row that has ``steps`` rows before it: those rows as ``x`` (steps by columns), its own
    target as ``label`` and its own time as ``label_ts``. With ``share``, each sequence is marked
    train or test by its position among the sequences of its series.
    """
    numbered = number_rows(df, spec, "_rn", "_n")
    panel = to_panel(numbered, spec, before=steps, index=F.col("_rn"))
    history = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(panel.frame(-steps, -1))
    rows = panel.add(x=history).home().filter(F.col("_rn") > steps)
    part = []
    if share is not None:
        cut = F.floor((F.col("_n") - steps) * F.lit(share))
        part = [F.when(F.col("_rn") - steps <= cut, "train").otherwise("test").alias("split")]
    return rows.select(
        *spec.keys, F.col(spec.time).alias("label_ts"), "x", F.col(target).alias("label"), *part
    )


def last_step(seq: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """The newest row of each sequence as flat columns: features of t-1 beside the label of t."""
    newest = F.element_at("x", -1)
    return seq.withColumns({c: newest[i] for i, c in enumerate(cols)})


def previous_step(df: DataFrame, cols: Sequence[str], spec: Series = HOURLY) -> DataFrame:
    """Replace ``cols`` by their values one row earlier; the first row of a series is dropped."""
    panel = to_panel(number_rows(df, spec, "_rn", "_n"), spec, before=1, index=F.col("_rn"))
    shifted = panel.add(**{c: F.lag(c).over(panel.window) for c in cols}).home()
    return shifted.filter(F.col("_rn") > 1).drop("_rn", "_n")
