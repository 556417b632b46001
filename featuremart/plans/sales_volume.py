"""Long-term sales volume per product with an active-day filter and a rank.

The quantities per product and paid day add up, so they can be kept as a store: a table partitioned by day, of which a
run replaces its own day (``update_store``). Two years are then read from the store and one day from the order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featuremart import schemas, sink
from featuremart.functions.expr import day_key_from_text
from featuremart.operators.relops import ranked_head
from featuremart.sources.scans import Days, range_scan


def paid_quantity(order: DataFrame, start: str, end: str) -> DataFrame:
    """(gds_id, statis_date, sum): quantity per product and paid day. Only lines paid on their partition day count."""
    a = range_scan(order, start, end, "gds_id", "tot_qty", "statis_date", "pay_time")
    a = a.where(day_key_from_text(F.col("pay_time")) == F.col("statis_date"))
    return a.groupBy("gds_id", "statis_date").agg(F.sum("tot_qty").alias("sum"))


def update_store(order: DataFrame, days, path: str | None = None, table: str | None = None) -> None:
    """Replace the partitions of ``days`` (a day or a ``(lo, hi)`` range) in the store; other days stay. A day without paid
    lines is emptied, so a repeated run leaves the same store."""
    d = Days.of(days)
    daily = paid_quantity(order, d.lo, d.hi)
    sink.write_day(daily.drop("statis_date") if d.single else daily, schemas.PAID_QUANTITY_T, d, path=path, table=table)


def read_store(spark: SparkSession, start: str, end: str, path: str | None = None, table: str | None = None) -> DataFrame:
    """(gds_id, statis_date, sum) of the store's days in [start, end]: a partition-pruned read."""
    return sink.read_day(spark, schemas.PAID_QUANTITY_T, start, path=path, hi=end, table=table)


def paid_days(order: DataFrame | None, start: str, end: str, store: DataFrame | None = None) -> DataFrame:
    """Per product and paid day: quantity ``sum``, number of paid days ``num`` and total
    ``sales_volume`` of the product, from the order lines or from the ``store``'s days.

    The two per-product windows run over the (product, day) aggregate, i.e. at most one row per
    day per product, whatever the product's share of the order lines."""
    b = paid_quantity(order, start, end) if store is None else range_scan(store, start, end)
    w = Window.partitionBy("gds_id")
    return b.select("gds_id", "statis_date", "sum",
                    F.count(F.lit(1)).over(w).alias("num"),
                    F.sum("sum").over(w).alias("sales_volume"))


def sales_volume(order: DataFrame | None, start: str = "20160101", end: str = "20171231", min_days: int = 600,
                 store: DataFrame | None = None) -> DataFrame:
    """Products paid on more than ``min_days`` days in [start, end] (rows per product and day)."""
    return paid_days(order, start, end, store).where(F.col("num") > min_days)


def sales_volume_rank(order: DataFrame | None, start: str = "20160101", end: str = "20171231", min_days: int = 600,
                      rank_limit: int | None = 10_000, dense: bool = False, store: DataFrame | None = None) -> DataFrame:
    """``sales_volume`` rows ranked by (num desc, sales_volume desc) with ``rank < rank_limit`` (``None``: all).

    The reference's outer ranking queries are lost (unbalanced parentheses); the rank is
    reconstructed as ``rank()`` over rows (``dense=True``: ``dense_rank``, i.e. by product)."""
    return ranked_head(sales_volume(order, start, end, min_days, store), ["num", "sales_volume"], rank_limit,
                       rank_col="rank", dense=dense)
