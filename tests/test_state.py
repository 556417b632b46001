"""Visit-day bitmasks and their daily state, the paid-quantity store and ranks from range partitions."""

import random
import re
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL, rows
from featuremart import schemas, sink
from featuremart.operators import relops
from featuremart.plans import sales_volume, visits
from featuremart.queries import DAY
from featuremart.sources import SourceTables, shift_day

VISIT = ("statis_date string, gds_id string, city_cd string, visitor_id string, visit_id string, busi_tp_id string, "
         "pv_qty bigint, oos_pv_qty bigint, one_pv_puv_flag int")
FIRST = date(2024, 1, 1)


def key(n):
    return (FIRST + timedelta(days=n)).strftime("%Y%m%d")


@pytest.fixture(scope="module")
def t(spark):
    return SourceTables.from_testdata(spark, SF_CHECK)


@pytest.fixture(scope="module")
def long_history(spark):
    """130 days of few visitors, with NULL keys, other business types and an unselected product."""
    rnd = random.Random(4)
    got = [(key(rnd.randrange(130)), rnd.choice(["1", "2", "3", "-", None]), rnd.choice(["a", "b", None]),
            rnd.choice(["v1", "v2", "v3", None]), "x", rnd.choice(["-", "Z-SHIP", "X"]), 1, 0, 1) for _ in range(700)]
    got += got[:40]
    return got, SourceTables(cust_visit=spark.createDataFrame(got, VISIT),
                             goods=spark.createDataFrame([("1",), ("2",)], "gds_cd string"))


def plain_returning(history, day, lookback, goods=("1", "2")):
    """{(product, city): returning visitors of the day number}, straight from the definition."""
    days = defaultdict(set)
    for d, g, c, v, _, tp, *_ in history:
        if g in goods and tp in ("-", "Z-SHIP"):
            days[g, c, v].add((date(int(d[:4]), int(d[4:6]), int(d[6:])) - FIRST).days)
    out = {}
    for (g, c, _), seen in days.items():
        if any(day - lookback <= x <= day for x in seen):
            out[g, c] = out.get((g, c), 0) + (day in seen and any(day - lookback <= x < day for x in seen))
    return out


@pytest.mark.parametrize("lo, hi, lookback", [(40, 40, 7), (10, 37, 7), (10, 38, 7), (0, 129, 7), (20, 100, 28), (30, 90, 1)])
def test_masks_over_blocks(long_history, lo, hi, lookback):
    history, tables = long_history
    got = {tuple(r)[:3]: r["old_uv"] for r in visits.returning_visitors_range(tables, key(lo), key(hi), lookback).collect()}
    want = {(key(n), *k): v for n in range(lo, hi + 1) for k, v in plain_returning(history, n, lookback).items()}
    assert got == want


def test_mask_lookback_is_bounded(long_history):
    with pytest.raises(ValueError):
        visits.returning_visitors_range(long_history[1], key(1), key(2), lookback=29)


def test_daily_state_equals_the_scans(spark, long_history):
    history, tables = long_history
    state = None
    for n in range(30, 40):
        state = visits.visit_days(tables, key(n), state)
        if n % 3 == 0:  # cut the chain, as the written partitions do
            state = spark.createDataFrame(state.collect(), state.schema)
            scanned = visits.visit_days(tables, key(n))
            assert rows(state) == rows(scanned)
        got = {tuple(r)[:2]: r["old_uv"] for r in visits.returning_of_state(tables, state).collect()}
        assert got == plain_returning(history, n, 7)
    # a product selected later has its earlier days
    more = tables.replace(goods=spark.createDataFrame([("3",)], "gds_cd string"))
    got = {tuple(r)[:2]: r["old_uv"] for r in visits.returning_of_state(more, state).collect()}
    assert got == plain_returning(history, 39, 7, goods=("3",))


def test_state_bounds_are_those_of_the_daily_job(t):
    state = visits.visit_days(t, DAY)
    for first, last in ((1, 7), (2, 5), (3, 3)):
        daily = visits.returning_visitors(t, DAY, shift_day(DAY, -first), shift_day(DAY, -last))
        assert rows(visits.returning_of_state(t, state, first, last)) == rows(daily)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_of_visits(spark, t):
    ranged = plan(visits.gds_visit(t, ("20240110", "20240120")))
    assert "Window" not in ranged and "Expand" not in ranged
    state = spark.createDataFrame([], "gds_id string, city_cd string, visitor_id string, days bigint")
    daily = plan(visits.returning_of_state(t, visits.visit_days(t, DAY, state)))
    assert "20240115" in daily and "20240108" not in daily  # the day alone is scanned
    assert "Expand" not in plan(visits.visit_measures(t, DAY))


def test_visit_counts_when_visits_are_shared(spark):
    """Visits of several visitors, NULL visits and visitors, NULL measures."""
    rnd = random.Random(8)
    got = [(DAY, rnd.choice(["1", "2"]), rnd.choice(["a", None]), rnd.choice(["v1", "v2", "v3", None]),
            rnd.choice(["x1", "x2", "x3", None]), "-", rnd.choice([1, 2, None]), None, rnd.choice([0, 1, None])) for _ in range(60)]
    tables = SourceTables(cust_visit=spark.createDataFrame(got, VISIT), goods=spark.createDataFrame([("1",), ("2",)], "gds_cd string"))
    v = tables.cust_visit
    want = v.groupBy("gds_id", "city_cd").agg(
        F.sum("pv_qty").alias("pv_qty"), F.count_distinct("visitor_id").alias("visitor_num"), F.sum("oos_pv_qty").alias("oos_pv_qty"),
        F.count_distinct(F.when(F.col("one_pv_puv_flag") == 1, F.col("visit_id"))).alias("one_pv_puv_num"),
        F.count_distinct("visit_id").alias("visitors"))
    assert rows(visits.visit_measures(tables, DAY)) == rows(want)


# ---- the store of paid quantities --------------------------------------------------------------------

def test_store_is_additive_and_idempotent(spark, tmp_path):
    from featuremart.sources import testdata
    order, path = testdata.fx_order(spark, SF_SMALL), str(tmp_path / "store")
    want = rows(sales_volume.sales_volume(order, "20240101", "20240131", 3))
    sales_volume.update_store(order, ("20240101", "20240114"), path=path)
    for n in range(15, 32):  # day by day
        sales_volume.update_store(order, f"202401{n:02d}", path=path)
    read = lambda: sales_volume.read_store(spark, "20240101", "20240131", path=path)
    assert rows(sales_volume.sales_volume(None, "20240101", "20240131", 3, store=read())) == want
    before = rows(read())
    sales_volume.update_store(order, "20240110", path=path)  # a repeated day changes nothing
    assert rows(read()) == before
    # a corrected day replaces its own partition alone
    fixed = order.where("statis_date <> '20240110' OR gds_id > '5'")
    sales_volume.update_store(fixed, "20240110", path=path)
    assert rows(sales_volume.sales_volume(None, "20240101", "20240131", 3, store=read())) == rows(
        sales_volume.sales_volume(fixed, "20240101", "20240131", 3))
    sales_volume.update_store(order.limit(0), "20240110", path=path)  # a day without paid lines is emptied
    assert read().where("statis_date = '20240110'").count() == 0
    scan = plan(sales_volume.read_store(spark, "20240103", "20240104", path=path))
    assert re.search(r"PartitionFilters: \[[^\]]*20240103", scan)


# ---- ranks -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("dense", [False, True])
def test_all_ranks_equal_the_window(spark, dense):
    rnd = random.Random(2)
    data = [(i, rnd.choice([None, *range(40)]), rnd.choice([None, 0.5, 1.5, 2.5])) for i in range(3000)]
    data += [(i, 7, 1.5) for i in range(3000, 5000)]  # a tie with two fifths of all rows
    df = spark.createDataFrame(data, "id int, a int, b double").repartition(7)
    df.createOrReplaceTempView("ranked_rows")
    fn = "dense_rank" if dense else "rank"
    want = spark.sql(f"SELECT *, {fn}() OVER (ORDER BY a DESC NULLS LAST, b DESC NULLS LAST) AS r FROM ranked_rows")
    got = relops.ranked_head(df, ["a", "b"], None, "r", dense)
    assert rows(got) == rows(want)
    assert rows(relops.ranked_head(df, ["a", "b"], 30_000, "r", dense)) == rows(want)  # beyond MAX_HEAD
    assert rows(relops.ranked_head(df, ["a", "b"], 100, "r", dense)) == rows(want.where("r < 100"))


def test_all_ranks_hold_no_rows_in_one_task(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("a"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = relops._all_ranks(df.groupBy("a").agg(F.count("*").alias("__cnt")), ["a"], "r", False)
        text = plan(ranked)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # the only single partition holds one row per range: the ranges' totals
    single = text[:text.index("SinglePartition")]
    assert text.count("SinglePartition") == 1 and "HashAggregate(keys=[__range" in text[text.index("SinglePartition"):]
    assert single


# ---- one scan ----------------------------------------------------------------------------------------

def test_functions_scan_once(spark, t):
    from featuremart.functions import aggs
    from featuremart.sources import testdata
    li = testdata.read(spark, SF_SMALL, "lineitem", "l_returnflag", "l_extendedprice", "l_orderkey", "l_suppkey")
    once = [relops.topn_array(li, ["l_suppkey"], 3, "l_extendedprice", ["l_orderkey"]),
            relops.dau_count(testdata.fx_dau(spark, SF_SMALL), ["statis_date"])]
    for df in once:
        assert plan(df).count("FileScan") == 1
    median = aggs.median_by(li, ["l_returnflag"], "l_extendedprice")
    median.collect()
    final = plan(median)
    final = final[:final.index("== Initial Plan ==")] if "== Initial Plan ==" in final else final
    assert final.count("FileScan") == 1


def test_topn_array_of_groups_without_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", None, "y"), ("b", None, "z"), ("b", None, "w"), (None, 3, "q"),
                                ("a", 5, "u"), ("a", 5, "t")], "g string, k int, p string")
    got = {r["g"]: [tuple(e) for e in r["topn"]] for r in relops.topn_array(df, ["g"], 3, "k", ["p"]).collect()}
    none = (None, None)
    assert got == {"a": [(5, "t"), (5, "u"), (1, "x")], "b": [none] * 3, None: [(3, "q"), none, none]}
    assert {r["g"]: len(r["topn"]) for r in relops.topn_array(df, ["g"], 3, "k", ["p"], pad=False).collect()} == {"a": 3, "b": 0, None: 1}
