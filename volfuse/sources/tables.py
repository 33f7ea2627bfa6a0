"""Reading and writing of the tables that the steps exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volfuse.functions.casts import parse_ts, to_ts
from volfuse.schema import BARS_CSV, FUSED, POST_COLUMNS, RESULTS
from volfuse.operators.bars import rename_ohlcv
from volfuse.sources.columns import numeric_cols, resolve_price_col, resolve_ts_col
from volfuse.sources.records import read_quoted

_TEXT = {"header": True, "escape": '"', "encoding": "UTF-8"}


def _trimmed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_bars(spark: SparkSession, path: str, fmt: str = "csv", symbol: str | None = None) -> DataFrame:
    """Market rows as (symbol, ts, open, high, low, close, volume).

    The time column is found by name. CSV numbers are read as text and cast leniently, so that no
    pass over the data is spent on guessing types. A file without a price column called close keeps
    its first numeric column under that name; which CSV columns are numeric takes one pass.
    """
    if fmt == "csv":
        raw = _trimmed(spark.read.options(header=True).csv(path))
        ts = resolve_ts_col(raw)
        given = [c for c in raw.columns if c not in (ts, "symbol")]
        if not any(c.lower() == "close" for c in given):
            given = _numeric(raw, given)
        raw = raw.withColumns({c: F.col(c).try_cast("double") for c in given})
    else:
        raw = spark.read.format(fmt).load(path)
        ts = resolve_ts_col(raw)
    named = rename_ohlcv(raw)
    if "close" not in named.columns:
        named = named.withColumn("close", F.col(resolve_price_col(raw.drop(ts))))
    key = F.col("symbol") if "symbol" in named.columns else F.lit(symbol or "series")
    timed = isinstance(raw.schema[ts].dataType, (T.TimestampType, T.TimestampNTZType))
    at = F.col(ts).cast("timestamp_ntz") if timed else to_ts(ts)
    wanted = [f.name.lower() for f in BARS_CSV.fields[1:]]
    values = [F.col(c).cast("double") if c in named.columns else F.lit(None).cast("double").alias(c) for c in wanted]
    return named.select(key.alias("symbol"), at.alias("ts"), *values)


def _numeric(raw: DataFrame, cols: Sequence[str]) -> list[str]:
    """The text columns all of whose values are numbers, at least one."""
    facts = [F.struct(F.count(c), F.count(F.col(c).try_cast("double"))).alias(f"_{i}") for i, c in enumerate(cols)]
    counts = raw.agg(*facts).first() if cols else []
    return [c for c, (given, parsed) in zip(cols, counts, strict=True) if given == parsed and parsed]


def read_posts(spark: SparkSession, path: str, fmt: str = "csv", sep: str = ";", multi_line: bool = False) -> DataFrame:
    """The five post columns as text; missing columns are left out.

    Files are split between tasks, also with ``multi_line``, where quoted texts may span lines.
    """
    if fmt == "csv" and multi_line:
        raw = read_quoted(spark, path, sep)
    else:
        raw = spark.read.options(**_TEXT, sep=sep).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    raw = _trimmed(raw)
    return raw.select(*[F.col(c).cast("string") for c in POST_COLUMNS if c in raw.columns])


def read_table(spark: SparkSession, path: str, schema: T.StructType = FUSED, fmt: str = "csv") -> DataFrame:
    """A table one of the steps wrote, with its known schema; a missing path raises."""
    reader = spark.read.schema(schema)
    return reader.options(header=True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType = RESULTS, fmt: str = "csv") -> DataFrame:
    """Like ``read_table``, but a missing path gives an empty table."""
    try:
        return read_table(spark, path, schema, fmt)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def require(spark: SparkSession, *paths: str) -> None:
    """Raise when a needed input is not there."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            raise FileNotFoundError(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if fmt == "csv":
        writer.options(header=True, escape='"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_parts(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions that ``df`` has rows of and leave all others; a rerun of one day replaces that day.

    A partition whose rows are all gone stays as it was.
    """
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def write_by_day(df: DataFrame, path: str, time: str, day: str = "day") -> None:
    """Store rows by the day of ``time``, text or timestamp; days that ``df`` has rows of are replaced.

    Small days share a writing task and a hot one is split over several, so files have a sensible size. Rows whose
    time cannot be read are kept under the null day.
    """
    at = F.col(time) if isinstance(df.schema[time].dataType, (T.TimestampNTZType, T.TimestampType)) else parse_ts(time)
    write_parts(df.withColumn(day, F.to_date(at)).hint("rebalance", day), path, [day])


def read_by_day(spark: SparkSession, path: str, schema: T.StructType, day: str = "day") -> DataFrame:
    """A table stored by day; ``schema`` names its other columns, so no file is opened to find them."""
    return spark.read.schema(T.StructType([*[f for f in schema if f.name != day], T.StructField(day, T.DateType())])).parquet(path)


def profile(df: DataFrame) -> DataFrame:
    """Per column: rows, missing values, and whether it is numeric; one pass over the data."""
    numeric = set(numeric_cols(df))
    stats = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    facts = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(c in numeric).alias("is_numeric"),
                F.col("_rows").alias("n_rows"),
                F.col(c).alias("n_missing"),
            )
            for c in df.columns
        ]
    )
    return stats.select(F.inline(facts))


def head(df: DataFrame, time: str, n: int = 5) -> DataFrame:
    return df.orderBy(time).limit(n)
