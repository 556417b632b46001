"""Daily sales features per product x city x channel (N1a-N1e, N1).

Every job takes ``days``: one ``yyyyMMdd`` day (the reference's daily job) or a ``(lo, hi)`` range
computed in one pass with ``statis_date`` as a leading key (backfill)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featuremart.functions.aggs import distinct_count
from featuremart.functions.expr import day_key_by_parsing, day_key_from_text, safe_ratio
from featuremart.operators.joins import restrict_to
from featuremart.operators.relops import stack_and_sum
from featuremart.sources.scans import Days
from featuremart.sources.tables import SourceTables

KEYS = ["gds_id", "city_cd", "chnl_cd"]
MEASURES = ["sale_cnt", "sale_promotion_cnt", "sale_promotion_num", "goods_rejected_num", "sale_member_num",
            "gds_price", "sale_price"]
ORDER_BUSINESS_TYPES = ["Z", "-"]
PROMOTION_DEAL_TYPES = ["02", "03"]


def sales_base(t: SourceTables, days) -> DataFrame:
    """Order lines of the day with an order business type, restricted to the selected products.

    The reference's inner join to the product list is a semi join here (equal when product codes
    are unique, and never multiplies rows when they are not). The search (N4) and member (N5) jobs
    start from the same lines, so the daily runner builds this once and shares it (``visit_id`` is
    kept for N4)."""
    shared = ["visit_id"] if "visit_id" in t.order.columns else []
    o = Days.of(days).scan(t.order, "statis_date", *KEYS, *shared, "tot_qty", "oms_order_item_id", "busi_tp_id",
                           "rfd_time", "member_id", "tot_amnt", "shld_amnt", "order_time", "pay_time")
    o = o.where(F.col("busi_tp_id").isin(*ORDER_BUSINESS_TYPES))
    return t.selected(o)


def price_and_quantity(base: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Average list and paid unit price, quantity. Zero quantity gives a NULL price."""
    return base.groupBy(*keys).agg(
        safe_ratio(F.sum("tot_amnt"), F.sum("tot_qty")).alias("gds_price"),
        safe_ratio(F.sum("shld_amnt"), F.sum("tot_qty")).alias("sale_price"),
        F.sum("tot_qty").alias("sale_cnt"))


def _deals(t: SourceTables, d: Days) -> DataFrame:
    return (d.scan(t.deal, "order_item_id", "promotion_num", "deal_type")
            .where(F.col("promotion_num").isNotNull() & F.col("deal_type").isin(*PROMOTION_DEAL_TYPES)))


PROMOTED = "__promoted"


def with_promotion(base: DataFrame, t: SourceTables, days) -> DataFrame:
    """The base with the flag of N1c's lines, so that one pass over it gives all of N1."""
    d = Days.of(days)
    item = F.when(day_key_from_text(F.col("order_time")) == F.col("statis_date"), F.col("oms_order_item_id"))
    deals = _deals(t, d).select(*d.keys(F.col("order_item_id").alias("__item"))).distinct().withColumn(PROMOTED, F.lit(True))
    lines = base.withColumn("__item", item)
    return (lines.join(deals, d.keys("__item"), "left").drop("__item")
            .withColumn(PROMOTED, F.coalesce(PROMOTED, F.lit(False))))


def promotion_sales(base: DataFrame, t: SourceTables, days) -> DataFrame:
    """Lines ordered on the day that carry a promotion deal (deal type 02/03) of that day."""
    d = Days.of(days)
    deals = _deals(t, d)
    ordered_today = base.where(day_key_from_text(F.col("order_time")) == F.col("statis_date"))
    if d.single:
        promo = restrict_to(ordered_today, deals, "oms_order_item_id", "order_item_id")
    else:  # deals match lines of the same day
        promo = ordered_today.join(deals.select("statis_date", F.col("order_item_id").alias("oms_order_item_id")),
                                   ["statis_date", "oms_order_item_id"], "left_semi")
    return promo.groupBy(*d.keys(*KEYS)).agg(
        F.count("oms_order_item_id").alias("sale_promotion_cnt"),
        F.sum("tot_qty").alias("sale_promotion_num"))


def rejected_quantity(base: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """N1d: quantity refunded on the day (refund time parsed as a date; malformed -> no match)."""
    return (base.where(day_key_by_parsing(F.col("rfd_time")) == F.col("statis_date"))
            .groupBy(*keys).agg(F.sum("tot_qty").alias("goods_rejected_num")))


def paying_members(base: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """N1e: distinct members who paid on the day."""
    return (base.where(day_key_from_text(F.col("pay_time")) == F.col("statis_date"))
            .groupBy(*keys).agg(F.count_distinct("member_id").alias("sale_member_num")))


def sales_features(t: SourceTables, days, base: DataFrame | None = None, approx_distinct: bool = False
                   ) -> DataFrame:
    """The four measure tables combined as the reference's UNION ALL + SUM (stack-and-sum).

    The three measure tables that need no join (price and quantity, refunds, paying members) are
    computed in one grouped pass over the day's order lines; the promotion table (joined to the
    deals) is stacked onto it. Two scans of the base instead of four, same result: keys come
    from the full base in both forms; refund quantity and member count default to 0; and a NULL
    price (zero quantity) becomes 0 exactly when another measure table holds the key, because
    SUM skips the NULL and adds that table's 0; a NULL quantity likewise. ``approx_distinct`` counts paying members with a
    HyperLogLog sketch instead of exactly. A base of ``with_promotion`` carries the promotion lines' flag and needs no
    second branch."""
    d = Days.of(days)
    keys = d.keys(*KEYS)
    base = sales_base(t, d) if base is None else base
    flagged = PROMOTED in base.columns
    promoted = F.col(PROMOTED) if flagged else F.lit(False)
    refunded = day_key_by_parsing(F.col("rfd_time")) == F.col("statis_date")
    paid = day_key_from_text(F.col("pay_time")) == F.col("statis_date")
    one_pass = base.groupBy(*keys).agg(
        F.sum("tot_amnt").alias("__amnt"), F.sum("shld_amnt").alias("__shld"), F.sum("tot_qty").alias("sale_cnt"),
        F.sum(F.when(refunded, F.col("tot_qty"))).alias("goods_rejected_num"),
        distinct_count(F.when(paid, F.col("member_id")), approx_distinct).alias("sale_member_num"),
        F.coalesce(F.max(refunded), F.lit(False)).alias("__has_refund"),
        F.coalesce(F.max(paid), F.lit(False)).alias("__has_paid"),
        F.max(promoted).alias("__has_promotion"),
        F.count(F.when(promoted, F.col("oms_order_item_id"))).alias("sale_promotion_cnt"),
        F.sum(F.when(promoted, F.col("tot_qty"))).alias("sale_promotion_num"))
    other_table = F.col("__has_refund") | F.col("__has_paid") | F.col("__has_promotion")
    price = lambda amount: F.when(
        other_table, F.coalesce(safe_ratio(F.col(amount), F.col("sale_cnt")), F.lit(0.0))
    ).otherwise(safe_ratio(F.col(amount), F.col("sale_cnt")))
    one_pass = one_pass.select(
        *keys, F.when(other_table, F.coalesce("sale_cnt", F.lit(0).cast("bigint"))).otherwise(
            F.col("sale_cnt")).alias("sale_cnt"), F.coalesce("goods_rejected_num", F.lit(0).cast("bigint")).alias("goods_rejected_num"),
        "sale_member_num", price("__amnt").alias("gds_price"), price("__shld").alias("sale_price"), "sale_promotion_cnt",
        F.coalesce("sale_promotion_num", F.lit(0).cast("bigint")).alias("sale_promotion_num"))
    if flagged:
        return one_pass.select(*keys, *MEASURES)
    one_pass = one_pass.drop("sale_promotion_cnt", "sale_promotion_num")
    return stack_and_sum([one_pass, promotion_sales(base, t, d)], keys, MEASURES)


def sales_features_stacked(t: SourceTables, days, base: DataFrame | None = None) -> DataFrame:
    """N1 literally as four measure tables stacked and summed (reference form, for checks)."""
    d = Days.of(days)
    keys = d.keys(*KEYS)
    base = sales_base(t, d) if base is None else base
    frames = [price_and_quantity(base, keys), promotion_sales(base, t, d), rejected_quantity(base, keys),
              paying_members(base, keys)]
    return stack_and_sum(frames, keys, MEASURES)
