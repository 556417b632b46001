"""Exact counts from bitmaps: the dictionary, merging, active users and unique visitors of a period."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from featuremart.operators import bitmaps, relops
from featuremart.plans import visits
from featuremart.sources import SourceTables


def numbers_of(df, col="id"):
    return {r[col]: r["number"] for r in df.collect()}


def test_dictionary_is_dense_and_keeps_its_numbers(spark):
    ids = spark.createDataFrame([(f"v{i % 700}",) for i in range(2000)] + [(None,)], "id string")
    first = numbers_of(bitmaps.number_ids(ids, "id"))
    assert sorted(first.values()) == list(range(700)) and None not in first
    known = spark.createDataFrame(list(first.items()), "id string, number long")
    more = spark.createDataFrame([(f"v{i}",) for i in range(600, 900)], "id string")
    second = numbers_of(bitmaps.number_ids(more, "id", known))
    assert sorted(second.values()) == list(range(900)) and {k: second[k] for k in first} == first
    assert numbers_of(bitmaps.number_ids(ids.limit(0), "id")) == {}


def test_counts_merge_over_buckets(spark):
    rnd = random.Random(6)
    data = [(rnd.randrange(5), rnd.choice(["a", "b", None]), rnd.choice([None, rnd.randrange(70_000)])) for _ in range(4000)]
    data += [(1, "a", 5)] * 2000 + [(2, "none", None)]  # a hot id, a group without ids
    df = spark.createDataFrame(data, "day int, g string, id int")
    numbers = spark.range(70_000).select(F.col("id").cast("int"), ((F.col("id") * 12_347) % 70_000).alias("number"))
    made = bitmaps.bitmaps_of(df, ["day", "g"], "id", numbers)
    assert made.agg(F.max("bucket")).first()[0] > 1
    for keys in (["day", "g"], ["g"], ["day"], []):
        want = df.groupBy(*keys).agg(F.count_distinct("id").alias("ids"))
        assert rows(bitmaps.count_ids(made, keys)) == rows(want)
    with pytest.raises(Exception, match="not in the dictionary"):
        bitmaps.bitmaps_of(df, ["g"], "id", numbers.where("id <> 5")).collect()


def test_days_merge_into_periods_of_active_users(spark):
    rnd = random.Random(9)
    data = [(rnd.randrange(6), rnd.choice([0, 1, 2, None]), rnd.choice(["u1", "u2", "u3", "u4", None]),
             rnd.choice([f"i{i}" for i in range(9)] + [None])) for _ in range(120)] + [(9, None, "u", "i")]
    df = spark.createDataFrame(data, "day int, flag int, uid string, imei string")
    made = bitmaps.dau_bitmaps(df, ["day"], bitmaps.number_ids(df, "uid"), bitmaps.number_ids(df, "imei"))
    assert rows(bitmaps.dau_of_bitmaps(made, ["day"])) == rows(relops.dau_count(df, ["day"]))
    week = made.withColumn("week", F.floor(F.col("day") / 3))
    assert rows(bitmaps.dau_of_bitmaps(week, ["week"])) == rows(
        relops.dau_count(df.withColumn("week", F.floor(F.col("day") / 3)), ["week"]))


def test_visitors_of_periods(spark):
    t = SourceTables.from_testdata(spark, SF_SMALL)
    numbers = bitmaps.number_ids(t.cust_visit, "visitor_id")
    days = visits.visitor_bitmaps(t, ("20240110", "20240116"), numbers)
    v = visits._visits(t, t.cust_visit)
    for lo, hi in (("20240110", "20240116"), ("20240112", "20240112")):
        want = v.where(F.col("statis_date").between(lo, hi)).groupBy("gds_id", "city_cd").agg(
            F.count_distinct("visitor_id").alias("visitor_num"))
        assert rows(visits.period_visitors(days, lo, hi)) == rows(want)


def test_bitmaps_of_sparse_groups_take_a_word_per_id(spark):
    df = spark.range(3000).select((F.col("id") % 1000).alias("g"), F.col("id"))
    made = bitmaps.bitmaps_of(df, ["g"], "id", spark.range(3000).select("id", (F.col("id") * 7 + 63).alias("number")))
    assert made.count() <= 3000 and dict(made.dtypes)["bits"] == "bigint"  # not 4 KB per group and bucket
    assert rows(bitmaps.count_ids(made, ["g"])) == rows(df.groupBy("g").agg(F.count_distinct("id").alias("ids")))
    for plan in (made, bitmaps.count_ids(made, ["g"])):  # masks are updated in hash maps, nothing is sorted
        assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()
