"""Find columns by name or type when a file does not use the canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Accepted names of the time column, in order of preference.
TIME_NAMES = ["Timestamp", "timestamp", "date", "time", "Date"]


def resolve_ts_col(df: DataFrame) -> str:
    """The first accepted time name, else the first column."""
    return next((name for name in TIME_NAMES if name in df.columns), df.columns[0])


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def resolve_price_col(df: DataFrame) -> str:
    """``Close``, else the same name in any case, else the first numeric column."""
    if "Close" in df.columns:
        return "Close"
    by_name = [c for c in df.columns if c.lower() == "close"]
    return by_name[0] if by_name else numeric_cols(df)[0]
