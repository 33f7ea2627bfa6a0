"""Lenient casts: whatever cannot be read becomes null (or 0 for counts), never an error."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def finite_columns(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({c: finite(c) for c in (cols or df.columns) if c in floats})


def parse_ts(c: Column | str) -> Column:
    """Text to a UTC time without zone; an offset in the text is applied, none means UTC."""
    return F.try_to_timestamp(_col(c).cast("string")).cast("timestamp_ntz")


def to_ts(c: Column | str) -> Column:
    """Epoch seconds, as number or text, to a UTC time; anything else is parsed as a date text."""
    seconds = finite(_col(c).try_cast("double"))
    return F.coalesce(F.timestamp_seconds(seconds).cast("timestamp_ntz"), parse_ts(c))


def to_utc(c: Column | str, zone: str = "UTC") -> Column:
    """Times without zone that were taken in ``zone``, as UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), _col(c).cast("timestamp_ntz"))


def to_count(c: Column | str) -> Column:
    """Text or number to a whole number, cut off at the decimal point; unreadable is 0."""
    c = _col(c)
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))
