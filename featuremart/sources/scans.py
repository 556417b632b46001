"""Partition scans.

Day keys are ``yyyyMMdd`` strings and are always compared as strings, so the predicate reaches the
parquet/catalog scan as a partition filter (or a pushed filter for unpartitioned test files).
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_COL = "statis_date"


def _check_day(day: str) -> str:
    day = str(day)
    datetime.strptime(day, "%Y%m%d")  # raises ValueError on a malformed key
    return day


def shift_day(day: str, days: int) -> str:
    d = datetime.strptime(_check_day(day), "%Y%m%d").date() + timedelta(days=days)
    return d.strftime("%Y%m%d")


def days_between(lo: str, hi: str) -> int:
    """Days from ``lo`` to ``hi``."""
    return (datetime.strptime(_check_day(hi), "%Y%m%d") - datetime.strptime(_check_day(lo), "%Y%m%d")).days


def day_pred(day: str, col: str = DAY_COL) -> Column:
    return F.col(col) == F.lit(_check_day(day))


def range_pred(lo: str, hi: str, col: str = DAY_COL) -> Column:
    """Inclusive ``BETWEEN lo AND hi`` on the text day key."""
    return F.col(col).between(F.lit(_check_day(lo)), F.lit(_check_day(hi)))


def _text_day(df: DataFrame, col: str) -> DataFrame:
    """A partitioned folder read without a schema infers the day key as a number; the jobs compare
    it with text day keys, so it is turned back into text (after the filter, which still prunes)."""
    if col in df.columns and not isinstance(df.schema[col].dataType, T.StringType):
        return df.withColumn(col, F.col(col).cast("string"))
    return df


def day_scan(df: DataFrame, day: str, *cols: str, col: str = DAY_COL) -> DataFrame:
    """Single-day scan with an optional column subset."""
    out = _text_day(df.where(day_pred(day, col)), col)
    return out.select(*cols) if cols else out


def range_scan(df: DataFrame, lo: str, hi: str, *cols: str, col: str = DAY_COL) -> DataFrame:
    out = _text_day(df.where(range_pred(lo, hi, col)), col)
    return out.select(*cols) if cols else out


def as_day(d: date) -> str:
    return d.strftime("%Y%m%d")


class Days:
    """One day, or an inclusive range of days computed in one pass (backfill).

    A job scans the range once and adds ``statis_date`` in front of its grouping and join keys;
    for a single day the keys and output columns are exactly those of the daily job."""

    __slots__ = ("lo", "hi")

    def __init__(self, lo: str, hi: str | None = None):
        self.lo = _check_day(lo)
        self.hi = _check_day(hi if hi is not None else lo)
        if self.hi < self.lo:
            raise ValueError(f"empty day range {self.lo}..{self.hi}")

    @staticmethod
    def of(days: "str | tuple[str, str] | Days") -> "Days":
        if isinstance(days, Days):
            return days
        if isinstance(days, tuple):
            return Days(*days)
        return Days(days)

    @property
    def single(self) -> bool:
        return self.lo == self.hi

    def keys(self, *keys: str) -> list[str]:
        return list(keys) if self.single else [DAY_COL, *keys]

    def scan(self, df: DataFrame, *cols: str) -> DataFrame:
        if self.single:
            return day_scan(df, self.lo, *cols)
        if cols and DAY_COL not in cols:
            cols = (DAY_COL, *cols)
        return range_scan(df, self.lo, self.hi, *cols)

    def __repr__(self) -> str:
        return f"Days({self.lo!r}, {self.hi!r})"
