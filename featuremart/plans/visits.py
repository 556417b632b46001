"""Daily visit features per product x city.

Returning visitors are tests of visit-day bitmasks: one bit per day and (product, city, visitor), built by a
``bit_or`` with partial aggregation. For a day range the masks come from one scan; for the daily job they are a state
table that is shifted by one day, so that only the day itself is scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featuremart.functions.aggs import distinct_count
from featuremart.functions.expr import safe_ratio
from featuremart.operators import bitmaps
from featuremart.sources.scans import DAY_COL, Days, day_scan, days_between, range_pred, range_scan, shift_day
from featuremart.sources.tables import SourceTables

KEYS = ["gds_id", "city_cd"]
VISIT_BUSINESS_TYPES = ["Z-SHIP", "-"]
LOOKBACK = 7    # days before a visit that make its visitor a returning one
MASK_DAYS = 28  # days of a range that one mask holds, beside its look-back


def _of_products(df: DataFrame) -> DataFrame:
    return df.where(F.col("busi_tp_id").isin(*VISIT_BUSINESS_TYPES) & (F.col("gds_id") != "-"))


def _visits(t: SourceTables, df: DataFrame) -> DataFrame:
    df = _of_products(df)
    return df if "cust_visit" in t.restricted else t.selected(df)


def visit_measures(t: SourceTables, days, approx_distinct: bool = False) -> DataFrame:
    """Page views, visitors, out-of-stock views, one-page visits and visits.

    Every row becomes a visit row, which carries the measures, and a visitor row; both are reduced per (key, kind, id) with
    partial aggregation and then counted per key: one scan, two shuffles, no expansion for several distinct
    aggregates. With ``approx_distinct`` the three counts are HyperLogLog sketches over the raw rows: one grouped
    pass, no distinct shuffle."""
    d = Days.of(days)
    v = _visits(t, d.scan(t.cust_visit, *KEYS, "visitor_id", "visit_id", "busi_tp_id", "pv_qty", "oos_pv_qty",
                          "one_pv_puv_flag"))
    if approx_distinct:
        return v.groupBy(*d.keys(*KEYS)).agg(
            F.sum("pv_qty").alias("pv_qty"),
            distinct_count("visitor_id", True).alias("visitor_num"),
            F.sum("oos_pv_qty").alias("oos_pv_qty"),
            distinct_count(F.when(F.col("one_pv_puv_flag") == 1, F.col("visit_id")), True).alias("one_pv_puv_num"),
            distinct_count("visit_id", True).alias("visitors"))
    keys = d.keys(*KEYS)
    visit = {"visit": F.lit(True), "id": F.col("visit_id").cast("string"), "pv": F.col("pv_qty"), "oos": F.col("oos_pv_qty"),
             "one": F.col("one_pv_puv_flag") == 1}
    visitor = {"visit": F.lit(False), "id": F.col("visitor_id").cast("string"),
               **{c: F.lit(None).cast(v.schema[of].dataType) for c, of in (("pv", "pv_qty"), ("oos", "oos_pv_qty"))},
               "one": F.lit(None).cast("boolean")}
    both = F.array(*[F.struct(*[c.alias(f"__{name}") for name, c in row.items()]) for row in (visit, visitor)])
    ids = v.select(*keys, F.inline(both)).groupBy(*keys, "__visit", "__id").agg(
        F.sum("__pv").alias("__pv"), F.sum("__oos").alias("__oos"), F.max("__one").alias("__one"))
    known = F.col("__id").isNotNull()
    return ids.groupBy(*keys).agg(
        F.sum("__pv").alias("pv_qty"),
        F.count_if(known & ~F.col("__visit")).alias("visitor_num"),
        F.sum("__oos").alias("oos_pv_qty"),
        F.count_if(known & F.col("__visit") & F.col("__one")).alias("one_pv_puv_num"),
        F.count_if(known & F.col("__visit")).alias("visitors"))


def returning_visitors(t: SourceTables, day: str, d1: str | None = None, d7: str | None = None) -> DataFrame:
    """Visitors of the day who also visited in [d7, d1] (defaults: day-7 .. day-1)."""
    d1 = d1 or shift_day(day, -1)
    d7 = d7 or shift_day(day, -7)
    v = _visits(t, range_scan(t.cust_visit, d7, day, "statis_date", *KEYS, "visitor_id", "busi_tp_id"))
    per_visitor = v.groupBy(*KEYS, "visitor_id").agg(
        F.max(range_pred(d7, d1)).alias("old_visitor"),
        F.max(F.col("statis_date") == day).alias("new_visitor"))
    return per_visitor.groupBy(*KEYS).agg(
        F.count_if(F.col("old_visitor") & F.col("new_visitor")).alias("old_uv"))


def gds_visit(t: SourceTables, days, d1: str | None = None, d7: str | None = None, approx_distinct: bool = False,
              returning: DataFrame | None = None) -> DataFrame:
    """Visit measures with returning visitors (left join: no match -> NULL) and the bounce rate.
    Both sides are aggregated on (gds_id, city_cd), so the join reuses their partitioning.

    For a day range the returning visitors come from the one-pass backfill form (7-day look-back,
    i.e. the default d7 / d1 of the daily job). ``returning`` gives them from elsewhere (the state table)."""
    dd = Days.of(days)
    a = visit_measures(t, dd, approx_distinct)
    if returning is not None:
        d = returning
    elif dd.single:
        d = returning_visitors(t, dd.lo, d1, d7)
    else:
        if d1 is not None or d7 is not None:
            raise ValueError("gds_visit: explicit d1 / d7 only for a single day")
        d = returning_visitors_range(t, dd.lo, dd.hi)
    keys = dd.keys(*KEYS)
    return a.join(d, keys, "left").select(
        *keys, "pv_qty", "visitor_num", "oos_pv_qty", "one_pv_puv_num", "visitors", "old_uv",
        safe_ratio(F.col("one_pv_puv_num"), F.col("visitors")).alias("loss_rate"))


def returning_visitors_range(t: SourceTables, lo: str, hi: str, lookback: int = LOOKBACK) -> DataFrame:
    """N2b for every day in [lo, hi] in one pass (backfill form).

    The range is cut into blocks of ``MASK_DAYS``; a (product, city, visitor)'s days of a block and of the ``lookback`` days
    before it are the bits of one number. A visitor returns on a day whose bit is set if one of the ``lookback`` bits
    before it is, so all days of a block are tested by shifts, and counted per (product, city) before any day becomes a
    row. As in the daily form a product and city seen in the look-back has a row of the day, if only with 0."""
    if not 0 < lookback <= MASK_DAYS:
        raise ValueError(f"returning_visitors_range: a look-back of 1 to {MASK_DAYS} days")
    n_days = days_between(lo, hi) + 1
    width = min(MASK_DAYS, n_days)
    last = (n_days - 1) // width
    v = _visits(t, range_scan(t.cust_visit, shift_day(lo, -lookback), hi, "statis_date", *KEYS, "visitor_id", "busi_tp_id"))
    first = F.to_date(F.lit(lo), "yyyyMMdd")
    v = v.select(*KEYS, "visitor_id", F.date_diff(F.to_date("statis_date", "yyyyMMdd"), first).alias("__at"))
    if last:  # a block's last days are in the look-back of the next one
        blocks = F.array_distinct(F.array(*[F.floor(x / width).cast("int") for x in (F.col("__at"), F.col("__at") + lookback)]))
        v = v.withColumn("__block", F.explode(blocks)).where(F.col("__block").between(0, last))
    else:
        v = v.withColumn("__block", F.lit(0))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__at") - F.col("__block") * width + lookback)
    masks = v.groupBy(*KEYS, "visitor_id", "__block").agg(F.bit_or(bit).alias("__days"))
    before = F.shiftleft("__days", 1)
    for k in range(2, lookback + 1):
        before = before.bitwiseOR(F.shiftleft("__days", k))
    masks = masks.withColumn("__back", F.col("__days").bitwiseAND(before))
    counted = masks.groupBy(*KEYS, "__block").agg(
        F.bit_or("__days").alias("__seen"),
        *[F.count_if(_any_bit("__back", 1 << lookback + i)).alias(f"__d{i}") for i in range(width)])
    at = F.col("__block") * width
    rows = F.array(*[F.struct(F.date_format(F.date_add(first, at + i), "yyyyMMdd").alias("statis_date"),
                              _any_bit("__seen", (1 << lookback + 1) - 1 << i).alias("__row"),
                              F.col(f"__d{i}").alias("old_uv")) for i in range(width)])
    return (counted.select(*KEYS, F.inline(rows)).where(F.col("__row") & range_pred(lo, hi))
            .select("statis_date", *KEYS, "old_uv"))


# ---- returning visitors from a state table ----------------------------------------------------------

def _any_bit(mask: str, bits: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(bits).cast("long")) != 0


def visit_days(t: SourceTables, day: str, previous: DataFrame | None = None, lookback: int = LOOKBACK) -> DataFrame:
    """State of ``day``: (gds_id, city_cd, visitor_id, days), bit k of ``days`` set if the visitor saw the product in that
    city k days before (0 to ``lookback``).

    ``previous`` is the state of the day before: it is shifted by one bit and the day's visits are added, so one day is
    scanned. Without it the ``lookback`` days are scanned once. The state holds all products, not only the selected
    ones, so a product that is selected later has its earlier days."""
    cols = [*KEYS, "visitor_id"]
    one = F.lit(1).cast("long")
    if previous is None:
        v = _of_products(range_scan(t.cust_visit, shift_day(day, -lookback), day, "statis_date", *cols, "busi_tp_id"))
        ago = F.date_diff(F.to_date(F.lit(day), "yyyyMMdd"), F.to_date("statis_date", "yyyyMMdd"))
        seen = v.select(*cols, F.call_function("shiftleft", one, ago).alias("days"))
    else:
        today = _of_products(day_scan(t.cust_visit, day, *cols, "busi_tp_id")).select(*cols, one.alias("days"))
        held = F.shiftleft("days", 1).bitwiseAND(F.lit((1 << lookback + 1) - 1).cast("long"))
        seen = today.unionByName(previous.select(*cols, held.alias("days")).where("days <> 0"))
    return seen.groupBy(*cols).agg(F.bit_or("days").alias("days"))


def returning_of_state(t: SourceTables, state: DataFrame, first: int = 1, last: int = LOOKBACK) -> DataFrame:
    """N2b from the state of a day: visitors of the day who also came ``first`` to ``last`` days before. Products and
    cities seen on none of the days 0 to ``last`` have no row."""
    window = (1 << last + 1) - (1 << first)
    seen = t.selected(state.where(_any_bit("days", (1 << last + 1) - 1)))
    return seen.groupBy(*KEYS).agg(F.count_if(_any_bit("days", 1) & _any_bit("days", window)).alias("old_uv"))


# ---- unique visitors of a period from day bitmaps -----------------------------------------------------

def visitor_bitmaps(t: SourceTables, days, visitors: DataFrame) -> DataFrame:
    """(statis_date, gds_id, city_cd, bucket, bits): the day's visitors of each product and city as exact bitmaps over the
    dictionary ``visitors`` (visitor_id, number) of ``bitmaps.number_ids``; they merge into any period."""
    d = Days.of(days)
    v = _visits(t, range_scan(t.cust_visit, d.lo, d.hi, DAY_COL, *KEYS, "visitor_id", "busi_tp_id"))
    return bitmaps.bitmaps_of(v, [DAY_COL, *KEYS], "visitor_id", visitors)


def period_visitors(days_bitmaps: DataFrame, lo: str, hi: str) -> DataFrame:
    """Different visitors per product and city of a period, from its days' bitmaps (not the sum of the days' counts)."""
    return bitmaps.count_ids(days_bitmaps.where(range_pred(lo, hi)), KEYS, "visitor_num")
