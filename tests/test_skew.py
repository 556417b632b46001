"""A hot key holding a third of the rows: results must not change when AQE splits the skewed
join partition (forced here with tiny thresholds, as it would trigger at scale)."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from conftest import rows
from featuremart import sink
from featuremart.plans import members
from featuremart.queries import DAY
from featuremart.sources import SourceTables

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _skewed_sources(spark):
    n = 3000
    order = spark.range(n).select(
        F.lit(DAY).alias("statis_date"),
        (F.col("id") % 60).cast("string").alias("gds_id"),
        (F.col("id") % 7).cast("string").alias("city_cd"),
        # a third of all order lines belong to one member
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 700).cast("string")).alias("member_id"),
        F.lit("Z").alias("busi_tp_id"))
    member = spark.range(700).select(F.col("id").cast("string").alias("member_id")).union(
        spark.createDataFrame([("HOT",)], "member_id string")).select(
        "member_id", F.lit("161000000100").alias("mem_lvl"), F.lit("-").alias("age_range"), F.lit("F").alias("gender"))
    goods = spark.range(60).select(F.col("id").cast("string").alias("gds_cd"))
    return SourceTables(order=order, member=member, goods=goods, goods_broadcast_rows=0)


def test_member_join_with_a_hot_member_is_split_and_unchanged(spark):
    t = _skewed_sources(spark)

    def run():
        df = members.gds_member(t, DAY)
        out = rows(df)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        return out, buf.getvalue()

    plain, _ = _with_conf(spark, {**SKEW_CONF, "spark.sql.adaptive.skewJoin.enabled": "false"}, run)
    split, plan_text = _with_conf(spark, SKEW_CONF, run)
    assert split == plain
    assert "skew=true" in plan_text, plan_text
    # brute force: distinct (product, city, member) buyers per (product, city)
    buyers = {(str(i % 60), str(i % 7), "HOT" if i % 3 == 0 else str(i % 700)) for i in range(3000)}
    expected = {}
    for g, c, _ in buyers:
        expected[(g, c)] = expected.get((g, c), 0) + 1
    assert {(r[0], r[1]): r[2] for r in plain} == expected


def test_bucketed_members_are_not_shuffled(spark, monkeypatch):
    """No exchange above the member scan, with or without hot members; the same rows as from the plain table."""
    plain = _skewed_sources(spark)
    sink.write_bucketed(plain.member.union(spark.createDataFrame([(None, "x", "y", "z")], plain.member.schema)),
                        "members_in_buckets", "member_id", 4)
    t = plain.with_bucketed(member="members_in_buckets")
    assert t.replace(order=plain.order).bucketed == {"member"} and not t.replace(member=plain.member).bucketed
    no_broadcast = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}

    def run():
        df = members.gds_member(t, DAY)
        out, buf = rows(df), io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        return out, buf.getvalue()

    expected = rows(members.gds_member(plain, DAY))
    for most in (members.HOT_BUYS, 20):  # none, and the hot one alone
        monkeypatch.setattr(members, "HOT_BUYS", most)
        got, text = _with_conf(spark, no_broadcast, run)
        assert got == expected
        final = text.split("== Initial Plan ==")[0]
        assert "Bucketed: true" in text
        # buyers into the buckets, and the final aggregation
        assert len(re.findall(r"\bExchange \(", final)) == 2, final
        assert ("BroadcastHashJoin Inner" in final) == (most == 20), final


def test_median_of_a_hot_group_is_spread_over_salts(spark):
    from featuremart.functions import median_by
    df = spark.range(20000).select(F.when(F.col("id") % 5 != 0, "HOT").otherwise((F.col("id") % 50).cast("string")).alias("g"),
                                   (F.col("id") * 7 % 20011).cast("double").alias("x"))

    def run():
        med = median_by(df, ["g"], "x")
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            med.explain()
        return rows(med), buf.getvalue()

    got, text = _with_conf(spark, SKEW_CONF, run)
    assert got == rows(df.groupBy("g").agg(F.median("x")))
    # values meet the kept buckets by (group, leading bits, salt), never by group alone
    narrowing = [ln for ln in text.splitlines() if "SortMergeJoin" in ln and "Inner" in ln]
    assert narrowing and all("__salt" in ln and "__p" in ln for ln in narrowing), text
