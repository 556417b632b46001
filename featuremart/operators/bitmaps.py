"""Exact distinct counts that merge: bitmaps over dense numbers of the ids.

A dictionary gives every id a number; a group's ids are then bits, one row with a 64-bit word per 64 numbers that the
group touches. Bitmaps of days merge into bitmaps of any period by OR, and differences of sets are differences of counts,
so a period's exact count needs the days' bitmaps and no raw rows. A group of few ids has at most a row per id, so sparse
groups never take more room than (group, id) rows, and a word is a number that hash aggregation updates in place.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featuremart.functions.checks import require_columns
from featuremart.shared import stage

PARTS = 1024  # parts of the ids that are numbered side by side
WORD = 6      # ids of a word, as a power of two


def number_ids(ids: DataFrame, col: str, known: DataFrame | None = None) -> DataFrame:
    """The dictionary (``col``, number) of the different ids in ``col``: dense numbers from 0, NULL has none.

    ``known``, an earlier dictionary, keeps its numbers and new ids go on behind them, so bitmaps made with it stay
    right. Ids are dealt by hash to ``PARTS`` parts, each numbers its own (sorted, with spill), and the parts' sizes give the
    numbers before them. The result is written once, so that a number never changes within a run."""
    require_columns(ids, [col], "number_ids")
    new = ids.select(col).where(F.col(col).isNotNull()).distinct()
    start = 0
    if known is not None:
        new = new.join(known.select(col), col, "left_anti")
        start = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    dealt = new.withColumn("__part", F.pmod(F.xxhash64(col), F.lit(PARTS)).cast("int"))
    dealt = stage(dealt, "ids")
    so_far = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over PARTS rows at most
    before = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(so_far), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(col))
    numbered = dealt.withColumn("__place", place).join(F.broadcast(before), "__part").select(
        col, (F.lit(start).cast("long") + F.col("__before") + F.col("__place") - 1).alias("number"))
    if known is not None:
        numbered = known.select(col, "number").unionByName(numbered)
    return stage(numbered, "dictionary")


def bitmaps_of(df: DataFrame, group: Sequence[str], col: str, dictionary: DataFrame) -> DataFrame:
    """(group, bucket, bits): the ids in ``col`` of each group, bit i of bucket b for the number 64 b + i. Pairs are made different before they are joined to the
    dictionary, so a hot id or group moves once per task. A group without ids keeps a row without bits; an id that the
    dictionary lacks is an error."""
    require_columns(df, [*group, col], "bitmaps_of")
    pairs = df.select(*group, F.col(col).alias("__id")).distinct()
    numbers = dictionary.select(F.col(col).alias("__id"), F.col("number").alias("__number"))
    number = F.when(F.col("__id").isNotNull() & F.col("__number").isNull(), F.raise_error(
        F.concat(F.lit("bitmaps_of: not in the dictionary: "), F.col("__id").cast("string"))).cast("long")).otherwise(
        F.col("__number"))
    pairs = pairs.join(numbers, "__id", "left").select(*group, number.alias("__number"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("__number") % (1 << WORD)).cast("int"))
    return pairs.groupBy(*group, F.shiftright("__number", WORD).alias("bucket")).agg(F.bit_or(bit).alias("bits"))


def merge(bitmaps: DataFrame, group: Sequence[str]) -> DataFrame:
    """Bitmaps of the coarser ``group``: the ids in any of the merged groups."""
    return bitmaps.groupBy(*group, "bucket").agg(F.bit_or("bits").alias("bits"))


def count_ids(bitmaps: DataFrame, group: Sequence[str], out: str = "ids") -> DataFrame:
    """Number of different ids per ``group``; 0 for a group without any."""
    bits = F.when(F.col("bucket").isNotNull(), F.bit_count("bits").cast("long")).otherwise(F.lit(0).cast("long"))
    return merge(bitmaps, group).groupBy(*group).agg(F.sum(bits).alias(out))


def dau_bitmaps(df: DataFrame, group: Sequence[str], users: DataFrame, devices: DataFrame, flag: str = "flag",
                uid: str = "uid", imei: str = "imei") -> DataFrame:
    """(group, kind, bucket, bits) from which daily active users (U10) are counted: logged-in users (kind ``user``), all
    devices (``device``) and devices that were logged in (``logged``)."""
    on = F.col(flag) == 1
    kinds = {"user": (F.when(on, F.col(uid)), users.withColumnRenamed(uid, "__of")),
             "device": (F.when(F.col(flag).isNotNull(), F.col(imei)), devices.withColumnRenamed(imei, "__of")),
             "logged": (F.when(on, F.col(imei)), devices.withColumnRenamed(imei, "__of"))}
    frames = [bitmaps_of(df.select(*group, ids.alias("__of")), group, "__of", numbers).withColumn("kind", F.lit(kind))
              for kind, (ids, numbers) in kinds.items()]
    return functools.reduce(DataFrame.unionByName, frames)


def dau_of_bitmaps(bitmaps: DataFrame, group: Sequence[str], out: str = "dau") -> DataFrame:
    """U10 of any coarser group: users + (all devices - devices that were logged in)."""
    sign = F.when(F.col("kind") == "logged", -F.col("__ids")).otherwise(F.col("__ids"))
    return count_ids(bitmaps, [*group, "kind"], "__ids").groupBy(*group).agg(F.sum(sign).alias(out))
