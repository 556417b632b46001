"""Aggregate functions of the reference (U5-U8) as Catalyst aggregates or DataFrame operators.

``max_any``, ``max_min`` and ``letters_total`` are ordinary aggregate expressions with partial
(map-side) aggregation. The exact median is an operator (``median_by``) because Spark's
``median`` keeps every distinct value of a group in one buffer; ``median_by`` narrows the middle ranks
down by counts per leading bits of the values, so no task holds more than a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuremart.functions.checks import (TIMESTAMPS, require_columns, require_max_min_input, require_median_input,
                                          require_orderable, require_string)


def distinct_count(c: Column | str, approx: bool = False, rsd: float = 0.01) -> Column:
    """``COUNT(DISTINCT c)`` (A3). ``approx=True`` uses a HyperLogLog++ sketch (relative standard
    deviation ``rsd``): sketches merge map-side, so no (key, value) pairs are shuffled. Exact is the
    default and the reference's contract."""
    return F.approx_count_distinct(c, rsd) if approx else F.count_distinct(c)


def max_any(df: DataFrame, col: str) -> Column:
    """``max`` over any orderable type (U5); NULLs skipped, empty group -> NULL."""
    require_orderable(df, col, "max")
    return F.max(col)


def _as_double(df: DataFrame, col: str) -> Column:
    t = df.schema[col].dataType
    if isinstance(t, TIMESTAMPS):
        return F.unix_micros(F.col(col).cast("timestamp")) / F.lit(1e6)
    return F.col(col).try_cast("double")


def max_min(df: DataFrame, col: str, name: str = "max_min") -> list[Column]:
    """Maximum and minimum as doubles (U6): ``[name_max, name_min, name]`` where the last is the
    reference's text form ``'max<TAB>min'``. Text that does not parse as a number is skipped;
    an empty group gives NULLs."""
    require_max_min_input(df, col)
    v = _as_double(df, col)
    hi, lo = F.max(v), F.min(v)
    return [hi.alias(f"{name}_max"), lo.alias(f"{name}_min"),
            F.concat(hi.cast("string"), F.lit("\t"), lo.cast("string")).alias(name)]


def letters_total(df: DataFrame, col: str) -> Column:
    """Total number of characters of a text column (U8); NULL skipped, no rows -> 0."""
    require_string(df, col, "letters")
    return F.coalesce(F.sum(F.length(col)), F.lit(0).cast("bigint"))


def _join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys``, NULL with NULL."""
    named = right.select(*[F.col(c).alias(f"__r_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys])
    return left.join(named, on, how).drop(*[f"__r_{c}" for c in keys])


def ordered_key(x: Column) -> Column:
    """A 64-bit integer that orders like the double ``x``, equal only for equal values: exponent above
    52 bits of fraction, negated below zero; infinity above all finite values and NaN above that."""
    a = F.abs(x)
    guess = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023))
    ratio = a / F.pow(F.lit(2.0), guess)
    # the logarithm is rounded: one step either way makes 1 <= ratio < 2 (less only at the least exponent)
    e = (guess + F.when(ratio >= 2, 1).otherwise(0) - F.when((ratio < 1) & (guess > -1022), 1).otherwise(0))
    bits = (e + 1022) * F.lit(2 ** 52) + (a / F.pow(F.lit(2.0), e) * F.lit(2.0 ** 52)).cast("long")
    bits = F.when(F.isnan(x), 2 ** 63 - 1).when(a == float("inf"), 2047 * 2 ** 52).when(a == 0, 0).otherwise(bits)
    return F.when(x < 0, -bits).otherwise(bits)


def median_by(df: DataFrame, group: Sequence[str], col: str, out: str = "median", salts: int = 32) -> DataFrame:
    """Exact median of ``col`` per group (U7): odd count -> middle value, even -> mean of the two
    middle values (as double), NULLs skipped; a group with no non-NULL value gives NULL, and a NULL group is a
    group.

    A radix selection, all distributed and with partial aggregation before every shuffle: distinct values with
    counts per (group, value); then counts per (group, leading bits of the value's order-preserving integer), of
    which only the one or two buckets that hold the middle ranks are kept; the next bits likewise; at last the
    values that share the kept leading bits are ranked. Every ranking is a window over at most ``2 ** 22`` rows of
    a group whatever its size: 22, 21 and 21 bits of long and double, 16 and 16 of the shorter types. The joins
    that narrow the values use (group, leading bits, salt), so a group or bucket that holds most values is spread
    over ``salts`` tasks. ``salts`` changes speed only.
    """
    require_median_input(df, col)
    g = list(group)
    require_columns(df, [*g, col], "median")
    t = df.schema[col].dataType
    is_int = isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    shifts = [16] if is_int and not isinstance(t, T.LongType) else [42, 21]
    x = F.col(col).cast("long" if is_int else "double")
    # a group without a value is a row of its own, counted 0; the filter is on the count, so every use reads one exchange
    counted = df.select(*g, x.alias("__x")).groupBy(*g, "__x").agg(F.count("__x").alias("__c"))
    vals = counted.where("__c > 0").withColumn("__key", F.col("__x") if is_int else ordered_key(F.col("__x")))
    in_group = Window.partitionBy(*g)
    holds = lambda r: (F.col("__end") - F.col("__c") <= F.col(r)) & (F.col(r) < F.col("__end"))

    def narrowed(kept: DataFrame, bits: int) -> DataFrame:
        salt = F.pmod(F.xxhash64("__x"), F.lit(salts)).cast("int")
        spread = kept.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return _join_on(vals.withColumn("__p", F.shiftright("__key", bits)).withColumn("__salt", salt), spread,
                        [*g, "__p", "__salt"], "inner").drop("__salt")

    kept, above = None, None
    for bits in shifts:
        rows = vals if kept is None else narrowed(kept, above)
        rows = rows.withColumn("__p", F.shiftright("__key", bits))
        if kept is None:
            buckets = rows.groupBy(*g, "__p").agg(F.sum("__c").alias("__c"))
            n = F.sum("__c").over(in_group)
            buckets = buckets.select(*g, "__p", "__c", F.lit(0).cast("long").alias("__base"),
                                     F.floor((n - 1) / 2).alias("__klo"), F.floor(n / 2).alias("__khi"))
        else:
            buckets = rows.groupBy(*g, "__p").agg(
                F.sum("__c").alias("__c"), *[F.min(c).alias(c) for c in ("__base", "__klo", "__khi")])
        buckets = buckets.withColumn("__end", F.min("__base").over(in_group)
                                     + F.sum("__c").over(in_group.orderBy("__p")))
        kept = buckets.where(holds("__klo") | holds("__khi")).select(
            *g, "__p", (F.col("__end") - F.col("__c")).alias("__base"), "__klo", "__khi")
        above = bits
    # the kept buckets of a group follow one another, so ranks go on from the first one's
    last = narrowed(kept, above).withColumn("__end", F.min("__base").over(in_group)
                                            + F.sum("__c").over(in_group.orderBy("__key")))
    picked = last.groupBy(*g).agg(F.max(F.when(holds("__klo"), F.col("__x"))).alias("__vlo"),
                                  F.max(F.when(holds("__khi"), F.col("__x"))).alias("__vhi"))
    if g:  # groups without a value have a row too
        picked = _join_on(counted.groupBy(*g).agg(F.sum("__c").alias("__n")), picked, g, "left")
    middle = (F.col("__vlo").cast("double") + F.col("__vhi").cast("double")) / 2
    return picked.select(*g, (F.when(F.col("__n") > 0, middle) if g else middle).alias(out))
