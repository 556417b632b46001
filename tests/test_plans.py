"""Feature jobs: invariants of the reference's semantics, checked on the test data."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL, rows
from featuremart.plans import clct_cart, gather, members, sales, sales_volume, search, visits
from featuremart.plans.sales import KEYS as SALES_KEYS
from featuremart.queries import DAY, VOLUME_MIN_DAYS
from featuremart.sources import SourceTables, shift_day
from featuremart.sources.scans import day_scan


@pytest.fixture(scope="module")
def t(spark):
    return SourceTables.from_testdata(spark, SF_CHECK)


def test_sales_union_form_equals_left_join_form(spark, t):
    base = sales.sales_base(t, DAY)
    fs01 = sales.price_and_quantity(base)
    left = fs01
    for side, cols in ((sales.promotion_sales(base, t, DAY), ["sale_promotion_cnt", "sale_promotion_num"]),
                       (sales.rejected_quantity(base), ["goods_rejected_num"]),
                       (sales.paying_members(base), ["sale_member_num"])):
        left = left.join(side, SALES_KEYS, "left")
        for c in cols:
            left = left.withColumn(c, F.coalesce(c, F.lit(0)))
    union = sales.sales_features(t, DAY)
    cols = ["gds_id", "city_cd", "chnl_cd", "sale_cnt", "sale_promotion_cnt", "sale_promotion_num",
            "goods_rejected_num", "sale_member_num"]
    assert rows(union.select(*cols)) == rows(left.select(*cols))


def test_one_pass_sales_equals_four_stacked_tables(spark, t):
    for day in (DAY, "20240103", "20240130"):
        assert rows(sales.sales_features(t, day)) == rows(sales.sales_features_stacked(t, day))


def test_one_pass_sales_null_price_rule(spark):
    # zero quantity -> NULL price; it turns 0 only when another measure table holds the key
    order = spark.createDataFrame([
        ("20240115", "1", "c", "50", 0, "i1", "Z", None, "m1", 5.0, 4.0, "2024-01-14 10:00:00", "2024-01-14 11:00:00"),
        ("20240115", "2", "c", "50", 0, "i2", "Z", None, "m2", 5.0, 4.0, "2024-01-14 10:00:00", "2024-01-15 11:00:00"),
        ("20240115", "3", "c", "50", 0, "i3", "Z", "2024-01-15 12:00:00", "m3", 5.0, 4.0, "2024-01-15 10:00:00",
         "-"),
        ("20240115", "4", "c", "50", 0, "i4", "Z", "-", None, 5.0, 4.0, "2024-01-15 10:00:00", "2024-01-14"),
    ], "statis_date string, gds_id string, city_cd string, chnl_cd string, tot_qty bigint, oms_order_item_id string, "
       "busi_tp_id string, rfd_time string, member_id string, tot_amnt double, shld_amnt double, order_time string, "
       "pay_time string")
    goods = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "gds_cd string")
    deal = spark.createDataFrame([("20240115", "i4", "P1", "02")], "statis_date string, order_item_id string, "
                                 "promotion_num string, deal_type string")
    tt = SourceTables(order=order, goods=goods, deal=deal)
    got = {r.gds_id: (r.gds_price, r.goods_rejected_num, r.sale_member_num, r.sale_promotion_cnt)
           for r in sales.sales_features(tt, DAY).collect()}
    assert got == {"1": (None, 0, 0, 0), "2": (0.0, 0, 1, 0), "3": (0.0, 0, 0, 0), "4": (0.0, 0, 0, 1)}
    assert rows(sales.sales_features(tt, DAY)) == rows(sales.sales_features_stacked(tt, DAY))


def test_gather_keeps_sales_rows_at_channel_50(spark, t):
    n_sales = sales.sales_features(t, DAY).where("chnl_cd = '50'").count()
    wide = gather.feature_gather_for_day(t, DAY)
    assert wide.count() == n_sales == 226


def test_gather_union_form_equals_left_join_chain(spark, t):
    parts = (sales.sales_features(t, DAY), visits.gds_visit(t, DAY), clct_cart.gds_clct_cart(t, DAY),
             search.gds_search(t, DAY), members.gds_member(t, DAY))
    assert rows(gather.feature_gather(*parts)) == rows(gather.feature_gather_joined(*parts))


def test_gather_null_keys_do_not_pick_up_feature_rows(spark):
    s_cols = "gds_id string, city_cd string, chnl_cd string, " + ", ".join(
        f"{c} {'double' if c in ('gds_price', 'sale_price') else 'bigint'}" for c in gather.SALES_MEASURES)
    sal = spark.createDataFrame([("1", None, "50", 1, 0, 0, 0, 0, 1.0, 1.0), ("1", "c", "50", 2, 0, 0, 0, 0, 2.0, 2.0),
                                 ("1", "c", "51", 3, 0, 0, 0, 0, 3.0, 3.0)], s_cols)
    v_cols = "gds_id string, city_cd string, pv_qty bigint, visitor_num bigint, oos_pv_qty bigint, " \
             "one_pv_puv_num bigint, visitors bigint, old_uv bigint, loss_rate double"
    vis = spark.createDataFrame([("1", None, 9, 9, 9, 9, 9, 9, 0.5), ("1", "c", 5, 4, 0, 1, 2, None, 0.5),
                                 ("2", "c", 7, 7, 7, 7, 7, 7, 1.0)], v_cols)
    empty = lambda cols: spark.createDataFrame([], "gds_id string, city_cd string, " + ", ".join(
        f"{c} bigint" for c in cols))
    parts = (sal, vis, empty(gather.CART_COLUMNS), empty(gather.SEARCH_COLUMNS), empty(gather.MEMBER_COLUMNS))
    got = {r.city_cd: (r.sale_cnt, r.pv_qty, r.old_uv) for r in gather.feature_gather(*parts).collect()}
    assert got == {None: (1, None, None), "c": (2, 5, None)}
    assert rows(gather.feature_gather(*parts)) == rows(gather.feature_gather_joined(*parts))


def test_search_pre_reduction_equals_fan_out_join(spark, t):
    o = day_scan(t.order, DAY).where("gds_id != '-' AND visit_id != '-' AND busi_tp_id IN ('Z', '-')")
    o = o.join(t.goods.withColumnRenamed("gds_cd", "gds_id"), "gds_id", "left_semi")
    fan = (o.join(search.search_visits(t, DAY), ["gds_id", "city_cd", "visit_id"])
           .groupBy("gds_id", "city_cd").agg(F.sum("tot_qty").alias("tot_qty"),
                                             F.sum("search_visit_pv").alias("search_visit_pv"),
                                             F.sum("search_visit_uv").alias("search_visit_uv")))
    assert rows(search.gds_search(t, DAY)) == rows(fan)


def test_visit_pre_reduction_equals_direct_distinct_counts(spark, t):
    v = day_scan(t.cust_visit, DAY).where("busi_tp_id IN ('Z-SHIP', '-') AND gds_id != '-'")
    v = v.join(t.goods.withColumnRenamed("gds_cd", "gds_id"), "gds_id", "left_semi")
    direct = v.groupBy("gds_id", "city_cd").agg(
        F.sum("pv_qty").alias("pv_qty"), F.count_distinct("visitor_id").alias("visitor_num"),
        F.sum("oos_pv_qty").alias("oos_pv_qty"),
        F.count_distinct(F.when(F.col("one_pv_puv_flag") == 1, F.col("visit_id"))).alias("one_pv_puv_num"),
        F.count_distinct("visit_id").alias("visitors"))
    assert rows(visits.visit_measures(t, DAY)) == rows(direct)


def test_returning_range_form_equals_daily_form(spark, t):
    day = "20240112"
    daily = visits.returning_visitors(t, day)
    expected = rows(daily)
    rng = visits.returning_visitors_range(t, shift_day(day, -1), shift_day(day, 1))
    got = rows(rng.where(F.col("statis_date") == day).drop("statis_date"))
    assert got == expected


def test_app_click_key_with_null_part_never_joins(spark, t):
    clicks = spark.createDataFrame([(DAY, None, "c1v", "1_1", "o1", "121316"), (DAY, "1", "c1v", "1_1", "o1", "0")],
                                   "statis_date string, trmnl_tp_id string, clnt_id string, visit_id string, "
                                   "visit_order string, click_num string")
    t2 = t.replace(app_click=clicks)
    got = rows(clct_cart.app_click_flags(t2, DAY))
    assert got == [("1c1v1_1o1", 0, 0), (None, 1, 0)]


def test_member_counts_add_up(spark, t):
    m = members.gds_member(t, DAY)
    lv = " + ".join(["new", "v3", "v2", "v1", "orther", "vn"])
    ag = " + ".join([f"ar{i}" for i in range(1, 11)])
    bad = m.where(f"members != {lv} OR members != {ag} OR members != f + m + n")
    assert bad.count() == 0 and m.count() == 681


def test_sales_volume_rank_is_bounded_and_consistent(spark):
    from featuremart.sources import testdata
    order = testdata.fx_order(spark, SF_CHECK)
    ranked = sales_volume.sales_volume_rank(order, "20240101", "20240131", VOLUME_MIN_DAYS, 100)
    assert ranked.agg(F.max("rank")).collect()[0][0] < 100
    per_gds = ranked.select("gds_id", "num", "sales_volume", "rank").distinct()
    assert per_gds.count() == ranked.select("gds_id").distinct().count()


def test_results_do_not_depend_on_shuffle_partitions(spark):
    t_small = SourceTables.from_testdata(spark, SF_SMALL)
    ref = rows(gather.feature_gather_for_day(t_small, DAY))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows(gather.feature_gather_for_day(SourceTables.from_testdata(spark, SF_SMALL), DAY)) == ref
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(ref) == 24


def test_member_join_semantics_with_repeated_members(spark):
    # buyers without a member row drop out; a repeated member row counts twice (inner join)
    order = spark.createDataFrame([
        ("20240115", "1", "c", "m1", "Z"), ("20240115", "1", "c", "m1", "Z"), ("20240115", "1", "c", "m2", "-"),
        ("20240115", "1", "c", "m3", "Z"), ("20240115", "1", "c", "m4", "X"), ("20240114", "1", "c", "m5", "Z"),
    ], "statis_date string, gds_id string, city_cd string, member_id string, busi_tp_id string")
    member = spark.createDataFrame([
        ("m1", "161000000100", "40岁-49岁", "F"), ("m2", "161000000130", "other", "M"),
        ("m2", "161000000130", "other", "M"), ("m4", "-", "-", "N"), ("m5", "-", "-", "N"),
    ], "member_id string, mem_lvl string, age_range string, gender string")
    goods = spark.createDataFrame([("1",), ("1",)], "gds_cd string")
    r = members.gds_member(SourceTables(order=order, member=member, goods=goods), DAY).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.members, r.new, r.v3, r.ar1, r.ar10, r.f, r.m) == (3, 1, 2, 1, 2, 1, 2)


def test_visit_null_city_keeps_null_returning_count(spark):
    cv = spark.createDataFrame([
        ("20240115", "1", None, "v1", "s1", "Z-SHIP", 1, 0, 1),
        ("20240110", "1", None, "v1", "s0", "Z-SHIP", 1, 0, 0),
        ("20240115", "1", "c", "v2", "s2", "-", 2, 1, 0),
        ("20240112", "1", "c", "v2", "s3", "-", 1, 0, 0),
        ("20240115", "-", "c", "v3", "s4", "-", 1, 0, 0),
    ], "statis_date string, gds_id string, city_cd string, visitor_id string, visit_id string, busi_tp_id string, "
       "pv_qty bigint, oos_pv_qty bigint, one_pv_puv_flag int")
    goods = spark.createDataFrame([("1",), ("-",)], "gds_cd string")
    got = {r.city_cd: (r.pv_qty, r.visitors, r.old_uv, r.loss_rate)
           for r in visits.gds_visit(SourceTables(cust_visit=cv, goods=goods), DAY).collect()}
    # NULL city never matches in the left join: its returning count stays NULL, not 0
    assert got == {None: (1, 1, None, 1.0), "c": (2, 1, 1, 0.0)}


def test_catalog_binding_equals_test_binding(spark, t):
    from featuremart.sources import testdata
    names = {}
    for role, build in testdata.BINDING.items():
        build(spark, SF_CHECK).createOrReplaceTempView(f"fm_src_{role}")
        names[role] = f"fm_src_{role}"
    cat = SourceTables.from_catalog(spark, names)
    assert rows(gather.feature_gather_for_day(cat, DAY)) == rows(gather.feature_gather_for_day(t, DAY))


def test_unknown_source_role_is_rejected():
    with pytest.raises(ValueError):
        SourceTables(orders=None)


RANGE = ("20240113", "20240116")
RANGE_DAYS = ["20240113", "20240114", "20240115", "20240116"]


@pytest.mark.parametrize("job", [sales.sales_features, visits.visit_measures, visits.gds_visit,
                                 clct_cart.gds_clct_cart, search.gds_search, members.gds_member,
                                 gather.feature_gather_for_day])
def test_day_range_equals_the_daily_jobs(spark, t, job):
    from pyspark.sql import functions as F2
    daily = None
    for day in RANGE_DAYS:
        one = job(t, day).select(F2.lit(day).alias("statis_date"), "*")
        daily = one if daily is None else daily.unionByName(one)
    assert rows(job(t, RANGE)) == rows(daily)


def test_single_day_range_is_the_daily_job(spark, t):
    assert rows(sales.sales_features(t, (DAY, DAY))) == rows(sales.sales_features(t, DAY))
    with pytest.raises(ValueError):
        sales.sales_features(t, ("20240116", "20240113"))


def test_approx_distinct_counts_are_close_and_skip_the_distinct_shuffle(spark, t):
    import contextlib
    import io
    for job, cols in ((visits.visit_measures, ["visitor_num", "one_pv_puv_num", "visitors"]),
                      (clct_cart.gds_clct_cart, ["p_clct_uv_num", "cart_flag_uv_num"]),
                      (search.search_visits, ["search_visit_uv"])):
        exact = {tuple(r[:2]): r for r in job(t, DAY).collect()}
        approx_df = job(t, DAY, approx_distinct=True)
        approx = {tuple(r[:2]): r for r in approx_df.collect()}
        assert exact.keys() == approx.keys()
        for k in exact:
            for c in cols:
                e, a = exact[k][c], approx[k][c]
                assert abs(a - e) <= max(1, 0.05 * e), (job.__name__, k, c, e, a)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            approx_df.explain()
        assert "Expand" not in buf.getvalue()
    exact = {tuple(r[:3]): r.sale_member_num for r in sales.sales_features(t, DAY).collect()}
    approx = {tuple(r[:3]): r.sale_member_num for r in sales.sales_features(t, DAY, approx_distinct=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(approx[k] - exact[k]) <= max(1, 0.05 * exact[k]) for k in exact)


def test_search_and_members_from_the_shared_order_base(spark, t):
    base = sales.sales_base(t, DAY)
    assert rows(search.gds_search(t, DAY, base=base)) == rows(search.gds_search(t, DAY))
    assert rows(members.gds_member(t, DAY, base=base)) == rows(members.gds_member(t, DAY))
    rng = ("20240113", "20240115")
    rbase = sales.sales_base(t, rng)
    assert rows(search.gds_search(t, rng, base=rbase)) == rows(search.gds_search(t, rng))
    assert rows(members.gds_member(t, rng, base=rbase)) == rows(members.gds_member(t, rng))
