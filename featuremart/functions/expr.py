"""Column expressions (F1-F11, U1-U4). All are Catalyst expressions: they run inside whole-stage
code generation with no Python in the executor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_key_from_text(ts_text: Column) -> Column:
    """``'yyyy-MM-dd HH:mm:ss'`` text -> ``yyyyMMdd``: the first ten characters without their dashes
    (F1). A literal ``replace`` removes every ``-`` exactly as the pattern replace does, without
    running a regular expression per row."""
    return F.replace(F.substring(ts_text, 1, 10), F.lit("-"), F.lit(""))


def day_key_by_parsing(ts_text: Column) -> Column:
    """Day key through a date parse (F2); malformed text such as ``'-'`` gives NULL, not an error."""
    return F.date_format(F.try_to_date(ts_text), "yyyyMMdd")


def flag(cond: Column) -> Column:
    """``IF(cond, 1, 0)``; a NULL condition gives 0."""
    return F.when(cond, 1).otherwise(0)


def safe_ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL on a zero divisor, as the reference's engine does."""
    return F.try_divide(num.cast("double"), den.cast("double"))


# ---- user functions re-expressed as column expressions ------------------------------------------

GREETING_PREFIX = "Hello "


def greeting(c: Column) -> Column:
    """``'Hello ' + x``; NULL stays NULL."""
    return F.concat(F.lit(GREETING_PREFIX), c)


def array_contains_strict(arr: Column, x: Column) -> Column:
    """TRUE if ``x`` is an element, FALSE if not, NULL if the list or ``x`` is NULL.

    NULL elements simply do not match (plain ``array_contains`` would answer NULL there).
    """
    return F.when(arr.isNull() | x.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.exists(arr, lambda e: e.eqNullSafe(x)))


def total_score(name: Column, score_list: Column) -> Column:
    """``struct(name, totalScore)`` with the sum of every value of every map in the list.

    NULL values count 0 and a NULL list totals 0; sums are 64-bit.
    """
    per_map = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("bigint"),
                                    lambda acc, v: acc + F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint")))
    total = F.aggregate(score_list, F.lit(0).cast("bigint"), lambda acc, m: acc + F.coalesce(per_map(m), F.lit(0)))
    return F.struct(name.alias("name"), F.coalesce(total, F.lit(0).cast("bigint")).alias("totalScore"))


def name_pairs(full_name: Column, out: Sequence[str] = ("name", "surname")) -> Column:
    """Array of (name, surname) structs for the name-rows table function (U4)."""
    tokens = F.split(F.regexp_replace(full_name, r"\s+$", ""), r"\s+")
    n = F.size(tokens)
    t = lambda i: tokens.getItem(i)
    pair = lambda a, b: F.struct(a.alias(out[0]), b.alias(out[1]))
    empty = F.array().cast(f"array<struct<{out[0]}:string,{out[1]}:string>>")
    return (F.when(full_name.isNull() | (full_name == ""), empty)
             .when(n == 2, F.array(pair(t(0), t(1))))
             .when((n == 4) & (t(1) == "and"), F.array(pair(t(0), t(3)), pair(t(2), t(3))))
             .otherwise(empty))
