"""Reusable relational operators, all expressed as DataFrame plans.

Each operator keeps the work distributed: aggregations use Catalyst's partial (map-side)
aggregation, so a key holding a large share of the rows is pre-reduced in every task before the
shuffle; nothing is gathered on the driver or in one task except inputs with a proven bound.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuremart.functions.checks import require_columns, require_orderable, require_string
from featuremart.shared import stage


def stack_and_sum(frames: Sequence[DataFrame], keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Full-outer combination of measure tables without a join (O2).

    Each frame supplies some of ``measures``; the missing ones are padded with 0 of the measure's
    type (not NULL), the frames are stacked with ``unionByName`` and summed per key: one shuffle for
    all inputs, NULL keys grouped together, partial aggregation before the exchange.
    """
    keys, measures = list(keys), list(measures)
    types: dict[str, T.DataType] = {}
    for df in frames:
        require_columns(df, keys, "stack_and_sum")
        for m in measures:
            if m in df.columns and m not in types:
                types[m] = df.schema[m].dataType
    missing = [m for m in measures if m not in types]
    if missing:
        raise ValueError(f"stack_and_sum: no frame provides {missing}")
    padded = []
    for df in frames:
        cols = [F.col(k) for k in keys]
        cols += [F.col(m).cast(types[m].simpleString()).alias(m) if m in df.columns
                 else F.lit(0).cast(types[m].simpleString()).alias(m) for m in measures]
        padded.append(df.select(*cols))
    stacked = padded[0]
    for df in padded[1:]:
        stacked = stacked.unionByName(df)
    return stacked.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def count_by_label(df: DataFrame, keys: Sequence[str], counters: Sequence[tuple[str, Column]],
                   total: tuple[str, Column] | None = None) -> DataFrame:
    """One grouped pass of conditional counts ``SUM(CASE WHEN p THEN 1 ELSE 0 END)``.

    A NULL predicate counts as false, as in the CASE form.
    """
    aggs = []
    if total is not None:
        aggs.append(F.count(total[1]).alias(total[0]))
    aggs += [F.count_if(F.coalesce(p, F.lit(False))).alias(name) for name, p in counters]
    return df.groupBy(*keys).agg(*aggs)


def _rank_order(key: str, payload: Sequence[str]) -> list[Column]:
    return [F.col(key).desc_nulls_last()] + [F.col(p).asc_nulls_last() for p in payload]


def topn_rows(df: DataFrame, group: Sequence[str], n: int, key: str, payload: Sequence[str] = (),
              rank_col: str = "rn") -> DataFrame:
    """The ``n`` rows with the largest ``key`` per group, long form.

    Ties are broken by the payload columns (ascending), so the result does not depend on how the
    input is split; NULL keys are dropped. ``row_number() <= n`` lets Spark insert a per-task group
    limit below the shuffle (WindowGroupLimit), so at most ``n`` rows per group and task move.
    """
    if not isinstance(n, int) or n <= 0:
        raise ValueError("topn: n must be a positive int constant")
    require_columns(df, [*group, key, *payload], "topn")
    require_orderable(df, key, "topn")
    return _first_rows(df.where(F.col(key).isNotNull()), group, n, key, payload, rank_col)


def _first_rows(df: DataFrame, group: Sequence[str], n: int, key: str, payload: Sequence[str], rank_col: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*_rank_order(key, payload))
    return df.select(*group, key, *payload).withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def topn_array(df: DataFrame, group: Sequence[str], n: int, key: str, payload: Sequence[str] = (),
               pad: bool = True, out: str = "topn") -> DataFrame:
    """Array form of ``topn_rows``: ``array<struct<f0=key, f1.., >>`` in descending key order,
    padded to ``n`` with NULL rows as the reference's function returns it. Each collected list
    holds at most ``n`` rows. A group without any key is a group still (with n NULL rows, or none without padding):
    NULL keys rank last, so they are among its first rows and are only left out of the list. One scan."""
    if not isinstance(n, int) or n <= 0:
        raise ValueError("topn: n must be a positive int constant")
    require_columns(df, [*group, key, *payload], "topn")
    require_orderable(df, key, "topn")
    fields = [key, *payload]
    ranked = _first_rows(df, group, n, key, payload, "__rn")
    entry = F.struct(F.col("__rn").alias("__rn"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])
    arr = F.transform(F.sort_array(F.collect_list(F.when(F.col(key).isNotNull(), entry))),
                      lambda e: F.struct(*[e[f"f{i}"].alias(f"f{i}") for i in range(len(fields))]))
    res = ranked.groupBy(*group).agg(arr.alias(out))
    if pad:
        null_row = F.struct(*[F.lit(None).cast(df.schema[c].dataType).alias(f"f{i}") for i, c in enumerate(fields)])
        res = res.withColumn(out, F.concat(F.col(out), F.array_repeat(null_row, F.lit(n) - F.size(out))))
    return res


MAX_HEAD = 10_000  # distinct order tuples that one task ranks; beyond it ranks are made from range partitions


def ranked_head(df: DataFrame, order: Sequence[str], limit_rank: int | None, rank_col: str = "rank",
                dense: bool = False) -> DataFrame:
    """Rows whose ``rank()`` over ``order`` (all descending, NULLs last) is below ``limit_rank`` (W3, T4, N7); ``None``:
    all rows.

    A global rank window would run in one task over all rows. Instead rows are reduced to their distinct order tuples
    with multiplicities (partial aggregation). Only the first ``limit_rank - 1`` tuples can rank below the limit (rank >=
    position): up to ``MAX_HEAD`` of them are taken with a bounded top-k, ranked by a running sum of multiplicities and
    broadcast. More tuples, or all, are dealt by range of the order: each range ranks its own tuples, the ranges'
    totals (one row each) give the ranks before it, and ranks are joined back to the rows. ``dense=True`` gives
    ``dense_rank``.
    """
    order = list(order)
    require_columns(df, order, "ranked_head")
    if limit_rank is not None and limit_rank <= 1:
        return df.withColumn(rank_col, F.lit(None).cast("int")).where(F.lit(False))
    tuples = df.groupBy(*order).agg(F.count(F.lit(1)).alias("__cnt"))
    if limit_rank is not None and limit_rank - 1 <= MAX_HEAD:
        head = _first_ranks(tuples, order, limit_rank, rank_col, dense)
        side = F.broadcast(head)
    else:
        side = head = _all_ranks(tuples, order, rank_col, dense)
        if limit_rank is not None:
            side = head.where(F.col(rank_col) < limit_rank)
            if limit_rank < 2 ** 31:
                side = side.withColumn(rank_col, F.col(rank_col).cast("int"))
    cond = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate(order)])
    return df.join(side, cond, "inner").drop(*[f"__o{i}" for i in range(len(order))])


def _named(tuples: DataFrame, order: list[str], rank: Column, rank_col: str) -> DataFrame:
    return tuples.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], rank.alias(rank_col))


def _first_ranks(tuples: DataFrame, order: list[str], limit_rank: int, rank_col: str, dense: bool) -> DataFrame:
    desc = [F.col(c).desc_nulls_last() for c in order]
    head = tuples.orderBy(*desc).limit(limit_rank - 1)
    w = Window.orderBy(*desc)  # over at most MAX_HEAD rows
    if dense:
        rank = F.row_number().over(w)
    else:
        rank = F.coalesce(F.sum("__cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return _named(head, order, rank.cast("int"), rank_col).where(F.col(rank_col) < limit_rank)


def _all_ranks(tuples: DataFrame, order: list[str], rank_col: str, dense: bool) -> DataFrame:
    """Ranks of all tuples. The dealt tuples are written once, as their range numbers must not change between the totals
    and the ranks. Tuples are distinct, so no range is forced to hold a group."""
    desc = [F.col(c).desc_nulls_last() for c in order]
    each = F.lit(1).cast("long") if dense else F.col("__cnt")
    dealt = stage(tuples.repartitionByRange(*desc).select(*order, each.alias("__n"), F.spark_partition_id().alias("__range")),
                  "ranks")
    so_far = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = dealt.groupBy("__range").agg(F.sum("__n").alias("__n")).select(
        "__range", F.coalesce(F.sum("__n").over(so_far), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(*desc).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    return _named(ranked.join(F.broadcast(before), "__range"), order, F.col("__before") + F.col("__inside") + 1, rank_col)


def name_rows(df: DataFrame, col: str, keep: Sequence[str] = (), out: tuple[str, str] = ("name", "surname")
              ) -> DataFrame:
    """Table function: a full name becomes 0, 1 or 2 (name, surname) rows (U4).

    Tokens are split on whitespace after trailing whitespace is removed. Two tokens give one row;
    four tokens whose second is exactly ``and`` give (t0, t3) and (t2, t3); anything else,
    including NULL and empty text, gives no row. Runs as a ``Generate`` inside the scan stage.
    """
    from featuremart.functions.expr import name_pairs
    require_columns(df, [col, *keep], "name_rows")
    require_string(df, col, "name_rows")
    return df.select(*keep, F.inline(name_pairs(F.col(col), out)))


def dau_count(df: DataFrame, group: Sequence[str], flag: str = "flag", uid: str = "uid", imei: str = "imei",
              out: str = "dau") -> DataFrame:
    """Deduplicated daily active users.

    dau = |uid with flag = 1| + |imei with flag <> 1| - |imei seen with both|, i.e. logged-in users
    plus devices that were only ever anonymous. Every row becomes a user row, if logged in, and a device row; both
    are reduced per (group, kind, id) and counted per group, so one scan and no sets. Rows with a NULL flag are ignored,
    NULL uid / imei are not counted; a group whose flags are all NULL counts 0.
    """
    require_columns(df, [*group, flag, uid, imei], "dau_count")
    if not isinstance(df.schema[flag].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        raise TypeError("dau_count: flag must be an integer column")
    require_string(df, uid, "dau_count")
    require_string(df, imei, "dau_count")
    logged = F.col(flag) == 1
    device = F.when(F.col(flag).isNotNull(), F.col(imei))
    seen = [F.struct(F.lit(False).alias("__user"), device.alias("__id"), logged.alias("__l"))]
    user = F.struct(F.lit(True).alias("__user"), F.col(uid).alias("__id"), logged.alias("__l"))
    both = F.when(logged & F.col(uid).isNotNull(), F.array(user, *seen)).otherwise(F.array(*seen))
    ids = (df.select(*group, F.inline(both)).groupBy(*group, "__user", "__id")
           .agg(F.max("__l").alias("__l")))
    counted = F.col("__id").isNotNull() & (F.col("__user") | ~F.col("__l"))
    return ids.groupBy(*group).agg(F.count_if(counted).alias(out))
