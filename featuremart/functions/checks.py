"""Bind-time argument checks (U11): wrong columns or types fail before any job runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
TIMESTAMPS = (T.TimestampType, T.TimestampNTZType)


def require_columns(df: DataFrame, cols: Sequence[str], op: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{op}: unknown column(s) {missing}; have {df.columns}")


def _type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def require_orderable(df: DataFrame, col: str, op: str) -> None:
    t = _type(df, col)
    if isinstance(t, (T.MapType, T.VariantType)):
        raise TypeError(f"{op}: {col} of type {t.simpleString()} is not orderable")


def require_median_input(df: DataFrame, col: str) -> None:
    t = _type(df, col)
    if not isinstance(t, INTEGRAL + FRACTIONAL):
        raise TypeError(f"median: {col} must be integral or floating point, got {t.simpleString()}")


def require_max_min_input(df: DataFrame, col: str) -> None:
    t = _type(df, col)
    if not isinstance(t, INTEGRAL + FRACTIONAL + TIMESTAMPS + (T.StringType,)):
        raise TypeError(f"max_min: {col} must be numeric, string or timestamp, got {t.simpleString()}")


def require_string(df: DataFrame, col: str, op: str) -> None:
    if not isinstance(_type(df, col), T.StringType):
        raise TypeError(f"{op}: {col} must be a string column, got {_type(df, col).simpleString()}")


def require_array_contains(df: DataFrame, arr: str, x: str) -> None:
    """``array_contains_strict`` takes a list of strings and a string."""
    require_columns(df, [arr, x], "array_contains")
    t = _type(df, arr)
    if not (isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType)):
        raise TypeError(f"array_contains: {arr} must be a list of strings, got {t.simpleString()}")
    require_string(df, x, "array_contains")
