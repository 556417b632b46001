"""Binding of the reference's source tables to the generated test data.

Every fixture is a projection over equi-joins of the TPC-H-like parquet tables. Products, cities, members
and visits are the tables' own keys, so rows and keys grow with the scale factor; the same expressions,
inlined as CTEs, form the DuckDB oracle (``featuremart.oracle``). ``day(n)`` is 2024-01-01 plus n days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featuremart.plans.members import AGE_COLUMNS

# Fixed values of the binding (they must equal the oracle's).
BASE_DAY = "2024-01-01"
KEYWORD = "kw"
# Member levels by market segment; nation 0 gets an unknown level.
SEGMENT_LEVEL = {
    "BUILDING": "161000000100",
    "MACHINERY": "161000000130",
    "FURNITURE": "161000000120",
    "AUTOMOBILE": "161000000110",
    "HOUSEHOLD": "-",
}
UNKNOWN_LEVEL = "999"
# The member job's nine age labels, in its order; nation % 10 picks one, 9 -> unknown.
AGE_LABELS = [label for _, label in AGE_COLUMNS]
UNKNOWN_AGE = "unknown"
GENDERS = ["F", "M", "N"]


def _cached(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Fixture DataFrames are pure functions of the read-only test files: build each plan once
    per session (DataFrames are immutable, so sharing them is safe)."""
    cache = spark.__dict__.setdefault("_featuremart_fixtures", {})
    if key not in cache:
        cache[key] = build()
    return cache[key]


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One test table, optionally pruned to ``cols``."""
    df = _cached(spark, ("read", sf_dir, name), lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return df.select(*cols) if cols else df


def fixture(fn):
    """Decorator: cache a fixture builder ``fn(spark, sf_dir)`` per session and folder."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _cached(spark, (fn.__name__, sf_dir), lambda: fn(spark, sf_dir))
    build.__name__ = fn.__name__
    build.__doc__ = fn.__doc__
    return build


def _txt(c: Column) -> Column:
    return c.cast("string")


def _money(c: Column) -> Column:
    """Amounts are exact decimals (two places in the test data), so sums do not depend on the
    order of addition."""
    return c.cast("decimal(15,2)")


def _day(offset: Column) -> Column:
    return F.date_add(F.to_date(F.lit(BASE_DAY)), offset.cast("int"))


def _day_key(offset: Column) -> Column:
    return F.date_format(_day(offset), "yyyyMMdd")


def _day_text(offset: Column, clock: str) -> Column:
    return F.concat(F.date_format(_day(offset), "yyyy-MM-dd"), F.lit(" " + clock))


@fixture
def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    od = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    cu = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    return li.join(od, li.l_orderkey == od.o_orderkey).join(cu, od.o_custkey == cu.c_custkey)


@fixture
def fx_goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part", "p_partkey", "p_size")
    return part.where(F.col("p_size") <= 30).select(_txt(F.col("p_partkey")).alias("gds_cd"))


@fixture
def fx_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n0 = F.col("o_orderkey") % 30
    line = F.col("l_linenumber")
    return _order_lines(spark, sf_dir).select(
        _day_key(n0).alias("statis_date"),
        _txt(F.col("l_partkey")).alias("gds_id"),
        _txt(F.col("c_nationkey")).alias("city_cd"),
        F.when(F.col("o_orderstatus") == "F", "50").when(F.col("o_orderstatus") == "O", "51")
         .when(F.col("o_orderstatus") == "P", "52").alias("chnl_cd"),
        F.col("l_quantity").cast("bigint").alias("tot_qty"),
        _money(F.col("l_extendedprice")).alias("tot_amnt"),
        (_money(F.col("l_extendedprice")) * (1 - _money(F.col("l_discount")))).alias("shld_amnt"),
        F.concat(_txt(F.col("l_orderkey")), F.lit("-"), _txt(line)).alias("oms_order_item_id"),
        F.when(F.col("l_linestatus") == "O", "Z").when(line == 7, "-").otherwise("X").alias("busi_tp_id"),
        _txt(F.col("o_custkey")).alias("member_id"),
        F.concat(_txt(F.col("o_custkey")), F.lit("_"), _txt(n0 + 1)).alias("visit_id"),
        _day_text(n0 + F.when(line == 1, 1).otherwise(0), "10:00:00").alias("order_time"),
        _day_text(n0 + line % 2, "11:00:00").alias("pay_time"),
        F.when(F.col("l_returnflag") == "R", _day_text(n0 + line % 3, "12:00:00")).alias("rfd_time"),
    )


@fixture
def fx_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    n0 = F.col("o_orderkey") % 30
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_tax")
    od = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        _day_key(n0).alias("statis_date"),
        F.concat(_txt(F.col("l_orderkey")), F.lit("-"), _txt(F.col("l_linenumber"))).alias("order_item_id"),
        F.when(F.col("l_tax") != 0,
               F.concat(F.lit("P"), F.round(F.col("l_tax") * 100).cast("bigint").cast("string")))
         .alias("promotion_num"),
        F.concat(F.lit("0"), F.substring("o_orderpriority", 1, 1)).alias("deal_type"),
    ).distinct()


@fixture
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its user is a customer, its visit that customer's day."""
    ev = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    return ev.select(
        "event_id", "user_id", "event_type", "value",
        F.date_format("ts", "yyyyMMdd").alias("statis_date"),
        _txt(F.col("user_id")).alias("visitor_id"),
        F.concat(_txt(F.col("user_id")), F.lit("_"), _txt(F.dayofmonth("ts"))).alias("visit_id"),
        F.lit(1).cast("bigint").alias("pv_qty"),
        F.when(et == "error", 1).otherwise(0).cast("bigint").alias("oos_pv_qty"),
        F.when(et == "view", 1).otherwise(0).alias("one_pv_puv_flag"),
        F.when(et == "signup", "X").when(F.col("value") < 20, "-").otherwise("Z-SHIP").alias("busi_tp_id"),
        F.when(et == "view", "-").otherwise(KEYWORD).alias("from_key_word"),
    )


@fixture
def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page views: a page shows the products that its user's orders hold, in the user's city."""
    shown = _order_lines(spark, sf_dir).select(
        "o_custkey", _txt(F.col("l_partkey")).alias("gds_id"), _txt(F.col("c_nationkey")).alias("city_cd"))
    return _events(spark, sf_dir).join(shown, F.col("user_id") == F.col("o_custkey")).drop("o_custkey")


VISIT_COLS = ["statis_date", "pv_id", "visitor_id", "visit_id", "city_cd", "gds_id", "busi_tp_id", "from_key_word"]


@fixture
def fx_cust_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visits(spark, sf_dir).select(
        "statis_date", "gds_id", "city_cd", "visitor_id", "visit_id", "busi_tp_id",
        "pv_qty", "oos_pv_qty", "one_pv_puv_flag")


def _app_pv_id() -> Column:
    return F.concat(_txt(F.col("event_id") % 3), F.lit("c"), _txt(F.col("user_id")), F.lit("v"),
                    F.col("visit_id"), F.lit("o"), _txt(F.col("event_id")))


@fixture
def fx_web_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_visits(spark, sf_dir).where(F.col("event_id") % 2 == 0)
            .withColumn("pv_id", _txt(F.col("event_id"))).select(*VISIT_COLS))


@fixture
def fx_app_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (_visits(spark, sf_dir).where(F.col("event_id") % 2 == 1)
            .withColumn("pv_id", _app_pv_id()).select(*VISIT_COLS))


@fixture
def fx_web_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    et = F.col("event_type")
    p1 = (F.when(et == "click", "shoucang01").when(et == "purchase", "buy01").when(et == "signup", "shoucang02")
           .when(et == "error", "basic").otherwise("other"))
    p2 = (F.when(et == "click", F.when(F.col("value") < 30, "gmq").otherwise("zzz"))
           .when(et == "purchase", "tab").when(et == "signup", "shop").when(et == "error", "favorite")
           .otherwise("none"))
    pair = lambda a, b: F.struct(a.alias("prmtr_id_1"), b.alias("prmtr_id_2"))
    web = _events(spark, sf_dir).where(F.col("event_id") % 2 == 0)
    return web.select(
        "statis_date", _txt(F.col("event_id")).alias("pv_id"),
        F.inline(F.array(pair(p1, p2), pair(F.lit("other"), F.lit("none")))))


@fixture
def fx_app_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    et = F.col("event_type")
    num = F.when(et == "click", "121316").when(et == "purchase", "121312").when(et == "error", "1210709").otherwise("0")
    app = _events(spark, sf_dir).where(F.col("event_id") % 2 == 1)
    return app.select(
        "statis_date",
        _txt(F.col("event_id") % 3).alias("trmnl_tp_id"),
        F.concat(F.lit("c"), _txt(F.col("user_id")), F.lit("v")).alias("clnt_id"),
        "visit_id",
        F.concat(F.lit("o"), _txt(F.col("event_id"))).alias("visit_order"),
        F.explode(F.array(num, F.lit("0"))).alias("click_num"))


@fixture
def fx_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    seg = F.col("c_mktsegment")
    lvl = F.when(F.col("c_nationkey") == 0, UNKNOWN_LEVEL)
    for name, code in SEGMENT_LEVEL.items():
        lvl = lvl.when(seg == name, code)
    slot = F.col("c_nationkey") % 10
    age = F.lit(UNKNOWN_AGE)
    for i in reversed(range(len(AGE_LABELS))):
        age = F.when(slot == i, AGE_LABELS[i]).otherwise(age)
    g = F.col("c_custkey") % 3
    gender = F.when(g == 0, GENDERS[0]).when(g == 1, GENDERS[1]).otherwise(GENDERS[2])
    return cu.select(_txt(F.col("c_custkey")).alias("member_id"), lvl.alias("mem_lvl"),
                     age.alias("age_range"), gender.alias("gender"))


BINDING = {
    "order": fx_order,
    "goods": fx_goods,
    "deal": fx_deal,
    "cust_visit": fx_cust_visit,
    "web_visit": fx_web_visit,
    "app_visit": fx_app_visit,
    "web_click": fx_web_click,
    "app_click": fx_app_click,
    "member": fx_member,
}


def loaders(spark: SparkSession, sf_dir: str) -> dict:
    """Source tables of the feature jobs bound to the test data, each built on first use."""
    return {name: (lambda fn=fn: fn(spark, sf_dir)) for name, fn in BINDING.items()}


# ---- inputs of the function examples -------------------------------------------------------------

@fixture
def fx_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score lists per order line: one list of two maps (quantity, line number) per lineitem row,
    named by its order. Summing the per-row totals by name gives the per-order total."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_linenumber")
    return li.select(
        F.concat(F.lit("o"), _txt(F.col("l_orderkey"))).alias("name"),
        F.array(F.create_map(F.lit("qty"), F.col("l_quantity").cast("int")),
                F.create_map(F.lit("line"), F.col("l_linenumber"))).alias("score_list"))


@fixture
def fx_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    slot = F.col("p_partkey") % 5
    name = (F.when(slot == 0, F.col("p_name"))
             .when(slot == 1, F.col("p_brand"))
             .when(slot == 2, F.concat("p_type", F.lit(" and "), "p_name"))
             .when(slot == 3, F.concat("p_name", F.lit(" "), "p_name")))
    return part.select("p_partkey", name.alias("full_name"))


@fixture
def fx_dau(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return ev.select(
        F.date_format("ts", "yyyyMMdd").alias("statis_date"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("flag"),
        F.concat(F.lit("u"), _txt(F.col("user_id"))).alias("uid"),
        F.concat(F.lit("i"), _txt(F.col("user_id") * 3 + F.col("event_id") % 3)).alias("imei"))


@fixture
def fx_tb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for the ad-hoc client's table ``tb(a, b, c)``: empty codes where lineitem has
    return flag N / line status O."""
    li = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return li.select(
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("a"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus")).alias("b"),
        F.concat(_txt(F.col("l_orderkey")), F.lit("-"), _txt(F.col("l_linenumber"))).alias("c"))
