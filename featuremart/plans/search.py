"""Daily search-attributed sales per product x city."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featuremart.functions.aggs import distinct_count
from featuremart.operators.joins import not_placeholder
from featuremart.plans.clct_cart import channel_views
from featuremart.plans.sales import ORDER_BUSINESS_TYPES
from featuremart.plans.visits import KEYS, VISIT_BUSINESS_TYPES
from featuremart.sources.scans import Days
from featuremart.sources.tables import SourceTables

VISIT_KEYS = ["gds_id", "city_cd", "visit_id"]


def _channel_search(v: DataFrame, d: Days, approx: bool = False) -> DataFrame:
    v = v.where((F.col("from_key_word") != "-") & not_placeholder(*VISIT_KEYS)
                & F.col("busi_tp_id").isin(*VISIT_BUSINESS_TYPES))
    return v.groupBy(*d.keys(*VISIT_KEYS)).agg(
        F.count("pv_id").alias("search_visit_pv"),
        distinct_count("visitor_id", approx).alias("search_visit_uv"))


def search_visits(t: SourceTables, days, approx_distinct: bool = False, views: tuple | None = None) -> DataFrame:
    """Per product x city x visit, keyword page views and visitors, summed over web and app. ``views``: the shared
    page views of ``clct_cart.channel_views``."""
    d = Days.of(days)
    web, app = views or channel_views(t, d, *VISIT_KEYS, "pv_id", "visitor_id", "from_key_word", "busi_tp_id")
    both = _channel_search(app, d, approx_distinct).unionByName(_channel_search(web, d, approx_distinct))
    return both.groupBy(*d.keys(*VISIT_KEYS)).agg(
        F.sum("search_visit_pv").alias("search_visit_pv"),
        F.sum("search_visit_uv").alias("search_visit_uv"))


def gds_search(t: SourceTables, days, approx_distinct: bool = False, base: DataFrame | None = None,
               views: tuple | None = None) -> DataFrame:
    """Order quantity of search visits, with the visit's PV / UV counted once per order line.

    The reference joins order lines to search visits and sums, so PV and UV repeat once per order
    line of the visit. Order lines are first reduced per visit to (quantity, line count); the join
    is then one-to-one and ``pv * lines`` reproduces the repetition exactly, without fan-out rows
    and without a hot visit's lines landing in one join task. ``base`` may be the shared order
    lines of ``sales.sales_base`` (already filtered by business type and product)."""
    d = Days.of(days)
    if base is None:
        o = d.scan(t.order, *VISIT_KEYS, "tot_qty", "busi_tp_id")
        o = o.where(F.col("busi_tp_id").isin(*ORDER_BUSINESS_TYPES))
        o = t.selected(o)
    else:
        o = base
    o = o.where((F.col("gds_id") != "-") & (F.col("visit_id") != "-"))
    per_visit = o.groupBy(*d.keys(*VISIT_KEYS)).agg(F.sum("tot_qty").alias("qty"), F.count(F.lit(1)).alias("lines"))
    j = per_visit.join(search_visits(t, d, approx_distinct, views), d.keys(*VISIT_KEYS))
    return j.groupBy(*d.keys(*KEYS)).agg(
        F.sum("qty").alias("tot_qty"),
        F.sum(F.col("search_visit_pv") * F.col("lines")).alias("search_visit_pv"),
        F.sum(F.col("search_visit_uv") * F.col("lines")).alias("search_visit_uv"))
