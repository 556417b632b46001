"""Daily buyer demographics per product x city."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featuremart.operators.joins import bounded_broadcast
from featuremart.operators.relops import count_by_label
from featuremart.plans.sales import ORDER_BUSINESS_TYPES
from featuremart.plans.visits import KEYS
from featuremart.shared import stage
from featuremart.sources.scans import Days
from featuremart.sources.tables import SourceTables

# Member level codes, age-range labels and genders, each with its output column, in
# the order of the reference's member job. Labels are compared literally (two overlapping ranges
# included); ``vn`` and ``ar10`` count the known-but-unlisted values.
LEVEL_COLUMNS = [("new", "161000000100"), ("v3", "161000000130"), ("v2", "161000000120"),
                 ("v1", "161000000110"), ("orther", "-")]
AGE_COLUMNS = [("ar1", "40岁-49岁"), ("ar2", "19岁-24岁"), ("ar3", "18岁以下"), ("ar4", "-"), ("ar5", "35岁-39岁"),
               ("ar6", "50岁-59岁"), ("ar7", "34岁-39岁"), ("ar8", "25岁-29岁"), ("ar9", "60岁以上")]
GENDER_COLUMNS = [("f", "F"), ("m", "M"), ("n", "N")]
HOT_BUYS = 100_000   # rows of one member from which they don't go to its bucket
HOT_MEMBERS = 1_000_000  # such members (rows of the member table) that are broadcast
OUTPUT = (["members"] + [c for c, _ in LEVEL_COLUMNS] + ["vn"] + [c for c, _ in AGE_COLUMNS] + ["ar10"]
          + [c for c, _ in GENDER_COLUMNS])


def _other(col: str, known: list[str]):
    c = F.col(col)
    return c.isNotNull() & ~c.isin(*known)


def member_counters() -> list[tuple[str, object]]:
    lvl, age, gender = F.col("mem_lvl"), F.col("age_range"), F.col("gender")
    counters = [(name, lvl == code) for name, code in LEVEL_COLUMNS]
    counters.append(("vn", _other("mem_lvl", [code for _, code in LEVEL_COLUMNS])))
    counters += [(name, age == label) for name, label in AGE_COLUMNS]
    counters.append(("ar10", _other("age_range", [label for _, label in AGE_COLUMNS])))
    counters += [(name, gender == g) for name, g in GENDER_COLUMNS]
    return counters


def buyers(t: SourceTables, days, base: DataFrame | None = None) -> DataFrame:
    """Distinct (product, city, member) of the day's order lines (``base``: the shared order lines of
    ``sales.sales_base``)."""
    d = Days.of(days)
    if base is None:
        o = d.scan(t.order, *KEYS, "member_id", "busi_tp_id")
        o = o.where(F.col("busi_tp_id").isin(*ORDER_BUSINESS_TYPES))
        base = t.selected(o)
    return base.select(*d.keys(*KEYS), "member_id").distinct()


def with_members(t: SourceTables, bought: DataFrame) -> DataFrame:
    """``bought`` (with a ``member_id``) and the members' level, age and gender.

    A plain member table is shuffled by member_id, and AQE splits a hot member's partition. A table in buckets of
    member_id (``t.bucketed``) is not shuffled, only ``bought`` is, into its buckets; there AQE can't split, so
    members with more than ``HOT_BUYS`` rows of ``bought`` (there are at most rows / ``HOT_BUYS``) are joined apart,
    by a broadcast of their rows that is checked for its size, without a shuffle of theirs."""
    m = t.member.select("member_id", "mem_lvl", "age_range", "gender")
    if "member" not in t.bucketed:
        return bought.join(m, "member_id")
    bought = stage(bought.where(F.col("member_id").isNotNull()), "bought")
    hot = stage(bought.groupBy("member_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BUYS)
                .select("member_id"), "hot-members")
    if hot.isEmpty():
        return bought.join(m, "member_id")
    few = bounded_broadcast(hot, HOT_MEMBERS)
    theirs = bounded_broadcast(stage(m.join(few, "member_id", "left_semi"), "their-rows"), HOT_MEMBERS)
    return (bought.join(few, "member_id", "left_anti").join(m, "member_id")
            .unionByName(bought.join(few, "member_id", "left_semi").join(theirs, "member_id")))


def gds_member(t: SourceTables, days, base: DataFrame | None = None) -> DataFrame:
    """Buyers joined to the member table (inner: buyers without a member row drop out), then
    member, level, age and gender counts in one grouped pass. The member table is large, so the
    join is a shuffle join on member_id, or one into the member table's buckets."""
    d = Days.of(days)
    j = with_members(t, buyers(t, d, base))
    out = count_by_label(j, d.keys(*KEYS), member_counters(), total=("members", F.col("member_id")))
    return out.select(*d.keys(*KEYS), *OUTPUT)
