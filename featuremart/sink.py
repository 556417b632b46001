"""Sinks (K1-K5).

* ``conform``: rename job columns to the target's names explicitly (never by position), cast to
  the declared types, add the processing-time column in the sink only (K4, K5).
* ``write_day``: idempotent overwrite of one day partition (or of every day of a range); other days
  survive, and a day whose new result is empty is emptied (K2). A REBALANCE hint lets AQE size the
  output files.
* ``write_table``: plain create-or-replace of an unpartitioned result (K3).
* ``write_bucketed``: a dimension in buckets of its join key (S5, J8).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuremart.schemas import Target
from featuremart.sources.scans import Days, _check_day, shift_day


def etl_time() -> F.Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def conform(df: DataFrame, target: Target, day: str | None = None) -> DataFrame:
    src = {target.renames.get(c, c): c for c in df.columns}
    cols = []
    for f in target.schema.fields:
        if f.name == "etl_time" and "etl_time" not in src:
            cols.append(etl_time().alias("etl_time"))
        elif f.name == target.partition and target.partition and day is not None:
            cols.append(F.lit(_check_day(day)).alias(f.name))
        elif f.name in src:
            cols.append(F.col(src[f.name]).cast(f.dataType).alias(f.name))
        elif f.name == target.partition:
            continue
        else:
            raise ValueError(f"{target.name}: job result has no column for {f.name}")
    return df.select(*cols)


def write_day(df: DataFrame, target: Target, days, path: str | None = None, table: str | None = None) -> None:
    """Replace the partitions of ``days`` in the target (a parquet folder or a catalog table), as
    ``INSERT OVERWRITE ... PARTITION (statis_date = d)`` does: other days survive, a re-run replaces.

    ``days`` is one day (the frame has no ``statis_date``; it is added) or a ``(lo, hi)`` range
    (the frame carries ``statis_date``). Rows are written with dynamic partition overwrite (each
    day's files are swapped in at commit); days of the run that produced no rows are then emptied,
    so a re-run never leaves rows of a previous run behind."""
    d = Days.of(days)
    if not d.single and target.partition not in df.columns:
        raise ValueError(f"{target.name}: a day range needs a {target.partition} column")
    out = conform(df, target, d.lo if d.single else None)
    # one day's rows meet in few tasks (AQE splits a large day), so a range writes few files per day
    out = out.hint("rebalance") if d.single else out.hint("rebalance", F.col(target.partition))
    spark = df.sparkSession
    if table is not None and not spark.catalog.tableExists(table):
        out.limit(0).write.format("parquet").partitionBy(target.partition).saveAsTable(table)
    # the days the new result holds, gathered while writing (at most one entry per day of the run)
    seen = Observation(f"days_{target.name}")
    out = out.observe(seen, F.collect_set(target.partition).alias("days"))
    if table is not None:
        # Columns are already in the table's order and named like it; insertInto only adds the
        # dynamic partition overwrite.
        order = spark.table(table).columns
        out.select(*order).write.option("partitionOverwriteMode", "dynamic").insertInto(table, overwrite=True)
    elif path is not None:
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(target.partition).parquet(path))
    else:
        raise ValueError("write_day: give a path or a table")
    present = set(seen.get.get("days") or [])
    _empty_days(spark, target, [day for day in _day_list(d) if day not in present], path, table)


def _empty_days(spark: SparkSession, target: Target, days: list[str], path: str | None, table: str | None) -> None:
    """Static overwrite of each day with no rows (``INSERT OVERWRITE ... PARTITION (d)`` of nothing)."""
    if not days:
        return
    part = target.partition
    fields = [f for f in target.schema.fields if f.name != part]
    empty = spark.createDataFrame([], T.StructType(fields))
    view = f"__featuremart_empty_{target.name}"
    empty.createOrReplaceTempView(view)
    cols = ", ".join(f"`{f.name}`" for f in fields)

    def clear(day: str) -> None:
        if table is not None:
            spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({part} = '{day}') SELECT {cols} FROM {view}")
        else:
            empty.write.mode("overwrite").parquet(f"{path}/{part}={day}")

    with ThreadPoolExecutor(max_workers=8) as pool:  # jobs without rows, side by side
        list(pool.map(clear, days))


def _day_list(d: Days) -> list[str]:
    out, day = [], d.lo
    while day <= d.hi:
        out.append(day)
        day = shift_day(day, 1)
    return out


def read_day(spark: SparkSession, target: Target, day: str, path: str | None = None, hi: str | None = None,
             table: str | None = None) -> DataFrame:
    """Read one day partition (or the days ``day..hi``) back with the declared schema (no partition
    type inference), from a folder or a catalog table."""
    df = spark.table(table) if table is not None else spark.read.schema(target.schema).parquet(path)
    if hi is None:
        return df.where(F.col(target.partition) == F.lit(_check_day(day)))
    return df.where(F.col(target.partition).between(F.lit(_check_day(day)), F.lit(_check_day(hi))))


def has_day(spark: SparkSession, target: Target, day: str, path: str | None = None, table: str | None = None) -> bool:
    """Whether the target exists and holds rows of the day."""
    if table is not None and not spark.catalog.tableExists(table):
        return False
    try:
        return not read_day(spark, target, day, path=path, table=table).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


class CheckFailed(ValueError):
    """A day's result is not fit to be published."""


def check_day(df: DataFrame, target: Target, least_rows: int = 0) -> int:
    """Number of rows of a day's (or range's) result; an error if a key occurs twice in a day or rows are missing."""
    keys = [c for c in (target.partition, "gds_id", "gds_cd", "city_cd", "chnl_cd") if c in df.columns]
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    n, most = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most > 1:
        raise CheckFailed(f"{target.name}: a key of {', '.join(keys)} occurs {most} times")
    if n < least_rows:
        raise CheckFailed(f"{target.name}: {n} rows, at least {least_rows} expected")
    return n


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Create or replace a catalog table in sorted buckets of ``key``, one file a bucket, so that joins on the key
    don't shuffle it. Rows without a key, which no join finds, are left out. ``path``: folder of an external table."""
    out = (df.where(F.col(key).isNotNull()).repartition(buckets, key).write.mode("overwrite").format("parquet")
           .bucketBy(buckets, key).sortBy(key))
    (out if path is None else out.option("path", path)).saveAsTable(table)


def write_table(df: DataFrame, target: Target, path: str | None = None, table: str | None = None) -> None:
    """Create or replace an unpartitioned result (K3): a parquet folder or a catalog table."""
    out = conform(df, target).hint("rebalance").write.mode("overwrite")
    if table is not None:
        out.format("parquet").saveAsTable(table)
    elif path is not None:
        out.parquet(path)
    else:
        raise ValueError("write_table: give a path or a table")
