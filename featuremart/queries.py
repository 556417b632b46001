"""Registered queries: each runs one job or function of the library over the test tables of a
scale-factor folder, with the fixed parameters the DuckDB oracle (``featuremart.oracle``) uses.

Double results are rounded to 6 decimals with one IEEE formula shared with the oracle; money sums
are exact decimals in the test binding, so both engines round the same double. Everything else is
returned as computed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featuremart import schemas, sink
from featuremart.functions import aggs
from featuremart.functions.expr import array_contains_strict, greeting, total_score
from featuremart.operators import bitmaps, relops
from featuremart.plans import adhoc, clct_cart, daily, gather, members, sales, sales_volume, search, visits
from featuremart.shared import new_folder
from featuremart.sources import testdata
from featuremart.sources.scans import shift_day
from featuremart.sources.tables import SourceTables

# Fixed parameters shared with the oracle.
DAY = "20240115"
RANGE_LO, RANGE_HI = "20240110", "20240120"
VOLUME_START, VOLUME_END = "20240101", "20240131"
VOLUME_MIN_DAYS = 12
VOLUME_RANK_LIMIT = 100
TOPN = 3


def round6(c: Column) -> Column:
    """Half-even rounding to 6 decimals as plain IEEE arithmetic, ``rint(x * 1e6) / 1e6``, so Spark and
    the oracle produce the same double from the same input, whatever its size."""
    return F.rint(c * 1e6) / 1e6


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[round6(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def _tables(spark: SparkSession, sf_dir: str) -> SourceTables:
    return SourceTables.from_testdata(spark, sf_dir)


def _job(fn: Callable[[SourceTables, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(fn(_tables(spark, sf_dir), DAY))
    run.__name__ = fn.__name__
    return run


def _range_job(fn: Callable[[SourceTables, object], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The same job over RANGE_LO..RANGE_HI in one pass (backfill form, statis_date leading)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(fn(_tables(spark, sf_dir), (RANGE_LO, RANGE_HI)))
    run.__name__ = fn.__name__ + "_range"
    return run


def _lineitem(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return testdata.read(spark, sf_dir, "lineitem", *cols)


# ---- feature jobs ---------------------------------------------------------------------------------

def q_sal_price(t: SourceTables, day: str) -> DataFrame:
    return sales.price_and_quantity(sales.sales_base(t, day))


def q_sal_promotion(t: SourceTables, day: str) -> DataFrame:
    return sales.promotion_sales(sales.sales_base(t, day), t, day)


def q_sal_rejected(t: SourceTables, day: str) -> DataFrame:
    return sales.rejected_quantity(sales.sales_base(t, day))


def q_sal_members(t: SourceTables, day: str) -> DataFrame:
    return sales.paying_members(sales.sales_base(t, day))


def q_returning_visitors_range(t: SourceTables, day: str) -> DataFrame:
    return visits.returning_visitors_range(t, RANGE_LO, RANGE_HI)


def returning_visitors_state_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily form: the state as of the day before is a written partition; only the day itself is scanned."""
    t, before, path = _tables(spark, sf_dir), shift_day(DAY, -1), new_folder(spark, schemas.VISIT_DAYS_T.name)
    sink.write_day(visits.visit_days(t, before), schemas.VISIT_DAYS_T, before, path=path)
    held = sink.read_day(spark, schemas.VISIT_DAYS_T, before, path=path)
    return visits.returning_of_state(t, visits.visit_days(t, DAY, held))


def gds_member_bucketed_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member job over a member table in buckets of member_id."""
    path, t = new_folder(spark, "members"), _tables(spark, sf_dir)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    sink.write_bucketed(t.member, table, "member_id", 64, path=path)
    return members.gds_member(t.with_bucketed(member=table), DAY)


def _volume_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after a backfill of all days and a repeated run of one of them."""
    order, path = testdata.fx_order(spark, sf_dir), new_folder(spark, schemas.PAID_QUANTITY_T.name)
    sales_volume.update_store(order, (VOLUME_START, VOLUME_END), path=path)
    sales_volume.update_store(order, DAY, path=path)
    return sales_volume.read_store(spark, VOLUME_START, VOLUME_END, path=path)


def sales_volume_store_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_volume.sales_volume(None, VOLUME_START, VOLUME_END, VOLUME_MIN_DAYS, store=_volume_store(spark, sf_dir))


def sales_volume_rank_store_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_volume.sales_volume_rank(None, VOLUME_START, VOLUME_END, VOLUME_MIN_DAYS, VOLUME_RANK_LIMIT,
                                          store=_volume_store(spark, sf_dir))


def sales_volume_rank_all_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's rank: no limit, so no task holds the head."""
    order = testdata.fx_order(spark, sf_dir)
    return sales_volume.sales_volume_rank(order, VOLUME_START, VOLUME_END, 0, None)


def order_line_rank_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines by price and quantity below a rank of two million."""
    li = _lineitem(spark, sf_dir, "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return relops.ranked_head(li, ["l_extendedprice", "l_quantity"], 2_000_000).select("l_orderkey", "l_linenumber", "rank")


def sales_volume_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = testdata.fx_order(spark, sf_dir)
    return sales_volume.sales_volume(order, VOLUME_START, VOLUME_END, VOLUME_MIN_DAYS)


def sales_volume_rank_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = testdata.fx_order(spark, sf_dir)
    return sales_volume.sales_volume_rank(order, VOLUME_START, VOLUME_END, VOLUME_MIN_DAYS, VOLUME_RANK_LIMIT)


def sales_volume_dense_rank_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = testdata.fx_order(spark, sf_dir)
    return sales_volume.sales_volume_rank(order, VOLUME_START, VOLUME_END, VOLUME_MIN_DAYS, VOLUME_RANK_LIMIT,
                                          dense=True)


def adhoc_filter_limit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adhoc.filtered_fetch(testdata.fx_tb(spark, sf_dir), {"a": "", "b": ""}, ["a", "b", "c"], n=10,
                                order_by=["c"])


# ---- functions ------------------------------------------------------------------------------------

def greeting_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = testdata.read(spark, sf_dir, "customer", "c_custkey", "c_name")
    return c.select("c_custkey", greeting(F.col("c_name")).alias("greeting"))


def array_contains_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = testdata.read(spark, sf_dir, "part", "p_partkey", "p_name")
    return p.select("p_partkey", array_contains_strict(F.split("p_name", " "), F.lit("red")).alias("has_red"))


def total_score_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = testdata.fx_score(spark, sf_dir).select(total_score(F.col("name"), F.col("score_list")).alias("s"))
    return s.groupBy(F.col("s.name").alias("name")).agg(F.sum("s.totalScore").alias("total_score"))


def name_rows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.name_rows(testdata.fx_name(spark, sf_dir), "full_name", keep=["p_partkey"])


def name_rows_sql_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the SQL table function (lateral)."""
    from featuremart.functions.sql import register_functions
    register_functions(spark)
    testdata.fx_name(spark, sf_dir).createOrReplaceTempView("fx_name")
    return spark.sql("SELECT f.p_partkey, r.name, r.surname FROM fx_name f, LATERAL name_rows(f.full_name) r")


def sql_functions_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions by their SQL names, one row per order line."""
    from featuremart.functions.sql import register_functions
    register_functions(spark)
    return testdata.fx_score(spark, sf_dir).selectExpr(
        "greeting(name) AS greeting", "array_contains_strict(array(name, NULL), 'o1') AS is_o1",
        "total_score(name, score_list).totalScore AS total_score")


def sal_fs_target_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1 as its sink writes it: target names and types."""
    return round_doubles(sink.conform(sales.sales_features(_tables(spark, sf_dir), DAY), schemas.SALES_T, DAY))


def gds_search_target_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4 as its sink writes it, without the processing time."""
    return sink.conform(search.gds_search(_tables(spark, sf_dir), DAY), schemas.SEARCH_T, DAY).drop("etl_time")


def _target(job: Callable, target: schemas.Target) -> Callable[[SparkSession, str], DataFrame]:
    """A job's result as its sink writes it, without the processing time."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(sink.conform(job(_tables(spark, sf_dir), DAY), target, DAY).drop("etl_time"))
    return run


def _published(target: schemas.Target) -> Callable[[SparkSession, str], DataFrame]:
    """A target's partition, read back after a checked run of the day was published (K1-K5)."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = new_folder(spark, "mart")
        daily.publish_day(spark, _tables(spark, sf_dir), DAY, out, visit_state=True)
        return round_doubles(sink.read_day(spark, target, DAY, path=daily.target_path(out, target)).drop("etl_time"))
    return run


def max_any_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir, "l_returnflag", "l_linenumber", "l_suppkey", "l_extendedprice", "l_linestatus",
                   "l_shipdate")
    return round_doubles(li.groupBy("l_returnflag").agg(
        aggs.max_any(li, "l_linenumber").alias("max_int"),
        aggs.max_any(li, "l_suppkey").alias("max_long"),
        aggs.max_any(li, "l_extendedprice").alias("max_double"),
        aggs.max_any(li, "l_linestatus").alias("max_string"),
        F.date_format(aggs.max_any(li, "l_shipdate"), "yyyy-MM-dd HH:mm:ss").alias("max_ts")))


def max_min_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir, "l_returnflag", "l_extendedprice", "l_linenumber")
    price = aggs.max_min(li, "l_extendedprice", "price")[:2]
    line = aggs.max_min(li, "l_linenumber", "line")[:2]
    return round_doubles(li.groupBy("l_returnflag").agg(*price, *line))


def max_min_text_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum and minimum of text (in the text form) and of timestamps (in seconds)."""
    li = _lineitem(spark, sf_dir, "l_returnflag", "l_quantity", "l_shipdate").withColumn(
        "l_quantity", F.col("l_quantity").cast("string"))
    return round_doubles(li.groupBy("l_returnflag").agg(
        aggs.max_min(li, "l_quantity", "quantity")[2], *aggs.max_min(li, "l_shipdate", "ship")[:2]))


def median_null_groups_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NULL group (flag N) and a group without any value (flag A)."""
    li = _lineitem(spark, sf_dir, "l_returnflag", "l_extendedprice").select(
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"),
        F.when(F.col("l_returnflag") != "A", F.col("l_extendedprice")).alias("price"))
    return round_doubles(aggs.median_by(li, ["flag"], "price"))


def _median(col: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        li = _lineitem(spark, sf_dir, "l_returnflag", col)
        return round_doubles(aggs.median_by(li, ["l_returnflag"], col, out="median"))
    return run


def letters_total_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = testdata.read(spark, sf_dir, "documents", "lang", "text")
    return d.groupBy("lang").agg(aggs.letters_total(d, "text").alias("letters"))


def topn_rows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir, "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    return relops.topn_rows(li, ["l_suppkey"], TOPN, "l_extendedprice", ["l_orderkey", "l_linenumber"])


def topn_array_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array form of top-n (padded to n), flattened back to one row per slot for comparison."""
    li = _lineitem(spark, sf_dir, "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    arr = relops.topn_array(li, ["l_suppkey"], TOPN, "l_extendedprice", ["l_orderkey", "l_linenumber"])
    return arr.select("l_suppkey", F.posexplode("topn").alias("pos", "e")).select(
        "l_suppkey", (F.col("pos") + 1).alias("pos"), "e.f0", "e.f1", "e.f2")


def dau_count_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relops.dau_count(testdata.fx_dau(spark, sf_dir), ["statis_date"])


def _dau_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testdata.fx_dau(spark, sf_dir)
    return bitmaps.dau_bitmaps(rows, ["statis_date"], bitmaps.number_ids(rows, "uid"), bitmaps.number_ids(rows, "imei"))


def dau_bitmaps_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmaps.dau_of_bitmaps(_dau_bitmaps(spark, sf_dir), ["statis_date"])


def dau_period_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active users of the whole time, merged from the days' bitmaps."""
    return bitmaps.dau_of_bitmaps(_dau_bitmaps(spark, sf_dir), [])


def period_visitors_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique visitors per product and city of the range, merged from the days' bitmaps."""
    t = _tables(spark, sf_dir)
    numbers = bitmaps.number_ids(t.cust_visit, "visitor_id")
    return visits.period_visitors(visits.visitor_bitmaps(t, (RANGE_LO, RANGE_HI), numbers), RANGE_LO, RANGE_HI)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # sales features (N1a-N1e, N1)
        "sal_price": _job(q_sal_price),
        "sal_promotion": _job(q_sal_promotion),
        "sal_rejected": _job(q_sal_rejected),
        "sal_members": _job(q_sal_members),
        "sal_fs": _job(sales.sales_features),
        # visit features (N2a, N2b, N2, N2b backfill)
        "visit_measures": _job(visits.visit_measures),
        "returning_visitors": _job(visits.returning_visitors),
        "gds_visit": _job(visits.gds_visit),
        "returning_visitors_range": _job(q_returning_visitors_range),
        "returning_visitors_state": returning_visitors_state_q,
        # favourite / cart
        "web_click_flags": _job(clct_cart.web_click_flags),
        "app_click_flags": _job(clct_cart.app_click_flags),
        "gds_clct_cart": _job(clct_cart.gds_clct_cart),
        # search (N4a, N4)
        "search_visits": _job(search.search_visits),
        "gds_search": _job(search.gds_search),
        # members (N5) and the wide table
        "gds_member": _job(members.gds_member),
        "gds_member_bucketed": gds_member_bucketed_q,
        "feature_gather": _job(gather.feature_gather_for_day),
        # the same jobs over a day range in one pass (backfill)
        "sal_fs_range": _range_job(sales.sales_features),
        "gds_visit_range": _range_job(visits.gds_visit),
        "gds_clct_cart_range": _range_job(clct_cart.gds_clct_cart),
        "gds_search_range": _range_job(search.gds_search),
        "gds_member_range": _range_job(members.gds_member),
        "feature_gather_range": _range_job(gather.feature_gather_for_day),
        # conformed targets (K1, K4)
        "sal_fs_target": sal_fs_target_q,
        "gds_search_target": gds_search_target_q,
        "gds_visit_target": _target(visits.gds_visit, schemas.VISITS_T),
        "gds_clct_cart_target": _target(clct_cart.gds_clct_cart, schemas.FAVOURITE_CART_T),
        "gds_member_target": _target(members.gds_member, schemas.MEMBERS_T),
        # the wide table from a checked, published day
        "feature_gather_published": _published(schemas.GATHER_T),
        # sales volume (N7) and the ad-hoc fetch
        "sales_volume": sales_volume_q,
        "sales_volume_rank": sales_volume_rank_q,
        "sales_volume_dense_rank": sales_volume_dense_rank_q,
        "sales_volume_store": sales_volume_store_q,
        "sales_volume_rank_store": sales_volume_rank_store_q,
        "sales_volume_rank_all": sales_volume_rank_all_q,
        "order_line_rank": order_line_rank_q,
        "adhoc_filter_limit": adhoc_filter_limit_q,
        # functions
        "greeting": greeting_q,
        "array_contains_strict": array_contains_q,
        "total_score": total_score_q,
        "name_rows": name_rows_q,
        "name_rows_sql": name_rows_sql_q,
        "sql_functions": sql_functions_q,
        "max_any": max_any_q,
        "max_min": max_min_q,
        "max_min_text": max_min_text_q,
        "median_int": _median("l_linenumber"),
        "median_long": _median("l_suppkey"),
        "median_double": _median("l_extendedprice"),
        "median_null_groups": median_null_groups_q,
        "letters_total": letters_total_q,
        "topn_rows": topn_rows_q,
        "topn_array": topn_array_q,
        "dau_count": dau_count_q,
        # exact counts merged from day bitmaps
        "dau_bitmaps": dau_bitmaps_q,
        "dau_period": dau_period_q,
        "period_visitors": period_visitors_q,
    }
