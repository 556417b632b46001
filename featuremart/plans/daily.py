"""Daily run of the feature mart: five independent feature jobs, each written to its day
partition, then the wide table gathered from the written partitions.

Writing each result cuts the lineage: the gather reads five small day partitions, so losing
executors there never re-runs the upstream jobs. Re-running a day replaces only that day.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featuremart import schemas, sink
from featuremart.plans import clct_cart, gather, members, sales, search, visits
from featuremart.shared import new_folder
from featuremart.sources.scans import Days, days_between, shift_day
from featuremart.sources.tables import SourceTables


def target_path(root: str, target: schemas.Target) -> str:
    return os.path.join(root, target.name)


def _place(target: schemas.Target, out_root: str | None, database: str | None) -> dict:
    return {"table": f"{database}.{target.name}"} if database else {"path": target_path(out_root, target)}


def run_day(spark: SparkSession, t: SourceTables, days, out_root: str | None = None, persist_base: bool = True,
            parallel: bool = True, approx_distinct: bool = False, database: str | None = None, d1: str | None = None,
            d7: str | None = None, visit_state: bool = False,
            previous_state: dict | None = None) -> dict:
    """Compute and write every feature table of ``days`` under ``out_root``, or into catalog tables of
    ``database``; returns the paths or table names. ``d1`` and ``d7`` are the bounds of the returning visitors'
    earlier days for a single day (default: the day before, seven days before).

    ``days`` is one day, or a ``(lo, hi)`` range for a backfill: each job then scans the range once
    and writes all its day partitions in one job (N2's returning visitors by the one-pass look-back
    form instead of an 8-day scan per day). The five feature jobs are independent; with
    ``parallel`` their writes are submitted from separate threads, so Spark schedules their stages
    side by side. The page views of N3 and N4 are read from their sources once. The wide table is gathered after all five are written. ``approx_distinct``
    switches the distinct-visitor / member counts to HyperLogLog sketches (default exact).

    ``visit_state`` keeps the visitors' days as a state table beside the features: a day's run reads the partition of the
    day before and the day's visits instead of eight days of visits. Without that partition (a first run, a gap) the
    state is made from the look-back once; results are the same. ``previous_state`` names another place (path or table)
    to read the day before from."""
    d = Days.of(days)
    if (out_root is None) == (database is None):
        raise ValueError("run_day: give either an output root or a database")
    places = {tg.name: _place(tg, out_root, database) for tg in schemas.DAILY}
    returning = None
    if visit_state:
        place = _place(schemas.VISIT_DAYS_T, out_root, database)
        returning = _returning(spark, t, d, d1, d7, place, previous_state or place)
        places[schemas.VISIT_DAYS_T.name] = place
    base = sales.sales_base(t, d)
    views = gather.shared_views(t, d)
    if persist_base:  # the day's order lines: read by N1's two branches, N4 and N5
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        jobs = [
            (schemas.SALES_T, sales.sales_features(t, d, base=base, approx_distinct=approx_distinct)),
            (schemas.VISITS_T, visits.gds_visit(t, d, d1, d7, approx_distinct, returning)),
            (schemas.FAVOURITE_CART_T, clct_cart.gds_clct_cart(t, d, approx_distinct, views)),
            (schemas.SEARCH_T, search.gds_search(t, d, approx_distinct, base=base, views=views)),
            (schemas.MEMBERS_T, members.gds_member(t, d, base=base)),
        ]
        if parallel:
            with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
                done = [pool.submit(sink.write_day, df, target, d, **places[target.name]) for target, df in jobs]
                for f in done:
                    f.result()
        else:
            for target, df in jobs:
                sink.write_day(df, target, d, **places[target.name])
    finally:
        if persist_base:
            base.unpersist()

    def read(tg: schemas.Target):
        df = sink.read_day(spark, tg, d.lo, hi=None if d.single else d.hi, **places[tg.name]).drop("etl_time")
        return df.drop("statis_date") if d.single else df

    sal = read(schemas.SALES_T).withColumnRenamed("gds_cd", "gds_id")
    wide = gather.feature_gather(sal, read(schemas.VISITS_T), read(schemas.FAVOURITE_CART_T), read(schemas.SEARCH_T),
                                 read(schemas.MEMBERS_T))
    sink.write_day(wide, schemas.GATHER_T, d, **places[schemas.GATHER_T.name])
    return {name: next(iter(place.values())) for name, place in places.items()}


def _returning(spark: SparkSession, t: SourceTables, d: Days, d1: str | None, d7: str | None, place: dict,
               before_place: dict) -> DataFrame:
    """N2b of a day from the state table, whose partition of the day is written first."""
    if not d.single:
        raise ValueError("run_day: the visit state is kept for single days; a range has its own one-pass form")
    day, before, state = d.lo, shift_day(d.lo, -1), schemas.VISIT_DAYS_T
    first, last = days_between(d1 or before, day), days_between(d7, day) if d7 else visits.LOOKBACK
    if not 1 <= first <= last <= visits.LOOKBACK:
        raise ValueError(f"run_day: the state holds the {visits.LOOKBACK} days before the day")
    previous = None
    if sink.has_day(spark, state, before, **before_place):
        previous = sink.read_day(spark, state, before, **before_place)
    sink.write_day(visits.visit_days(t, day, previous), state, d, **place)
    return visits.returning_of_state(t, sink.read_day(spark, state, day, **place), first, last)


def publish_day(spark: SparkSession, t: SourceTables, days, out_root: str | None = None, database: str | None = None,
                least_rows: dict[str, int] | None = None, checks: Sequence[Callable[[dict[str, DataFrame]], None]] = (),
                visit_state: bool = False, **options) -> dict:
    """``run_day`` into a staging folder; the six feature tables are checked there, and only if all pass are their
    partitions replaced in the targets. Returns the number of rows by table.

    Checked are: no key twice in a day, at least ``least_rows`` (by table name) rows, as many gathered rows as sales rows
    at the gathered channel, and whatever ``checks`` raise on {table name: staged rows}. A failure leaves every target as it
    was. The targets are replaced one after the other from the staged rows, without running a job again, so a broken
    replacement can be repeated."""
    d = Days.of(days)
    if (out_root is None) == (database is None):
        raise ValueError("publish_day: give either an output root or a database")
    targets = [*schemas.DAILY, *([schemas.VISIT_DAYS_T] if visit_state else [])]
    places = {tg.name: _place(tg, out_root, database) for tg in targets}
    staged = run_day(spark, t, d, new_folder(spark, "day"), visit_state=visit_state,
                     previous_state=places.get(schemas.VISIT_DAYS_T.name), **options)
    frames = {tg.name: sink.read_day(spark, tg, d.lo, path=staged[tg.name], hi=None if d.single else d.hi)
              for tg in targets}
    counted = {tg.name: sink.check_day(frames[tg.name], tg, (least_rows or {}).get(tg.name, 0)) for tg in schemas.DAILY}
    sold = frames[schemas.SALES_T.name].where(F.col("chnl_cd") == gather.GATHERED_CHANNEL).count()
    if counted[schemas.GATHER_T.name] != sold:
        raise sink.CheckFailed(f"{schemas.GATHER_T.name}: {counted[schemas.GATHER_T.name]} rows of {sold} sales rows")
    for check in checks:
        check(frames)
    for tg in targets:
        df = frames[tg.name].drop(tg.partition) if d.single else frames[tg.name]
        sink.write_day(df, tg, d, **places[tg.name])
    return counted
