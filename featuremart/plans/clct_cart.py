"""Daily favourite / add-to-cart unique visitors per product x city."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featuremart.functions.aggs import distinct_count
from featuremart.functions.expr import flag
from featuremart.plans.visits import KEYS, VISIT_BUSINESS_TYPES
from featuremart.sources.scans import Days
from featuremart.sources.tables import SourceTables

# Click parameters and click codes that mark a favourite or a cart action.
WEB_FAVOURITE_P1 = ["shoucang01", "basic"]
WEB_FAVOURITE_P2 = ["gmq", "favorite"]
WEB_CART_P1 = ["buy01", "buy03"]
WEB_CART_P2 = ["gmq", "tab"]
APP_FAVOURITE_CODES = ["121316", "780801", "1010106", "1010202", "1010301", "1200220", "1210135"]
APP_CART_CODES = ["121312", "1210138", "1210709"]


def web_click_flags(t: SourceTables, days) -> DataFrame:
    """Per web page view, whether any click was a favourite / a cart action."""
    d = Days.of(days)
    c = d.scan(t.web_click, "pv_id", "prmtr_id_1", "prmtr_id_2")
    p1, p2 = F.col("prmtr_id_1"), F.col("prmtr_id_2")
    return c.groupBy(*d.keys("pv_id")).agg(
        F.max(flag(p1.isin(*WEB_FAVOURITE_P1) & p2.isin(*WEB_FAVOURITE_P2))).alias("p_clct_flag"),
        F.max(flag(p1.isin(*WEB_CART_P1) & p2.isin(*WEB_CART_P2))).alias("cart_flag"))


def app_click_flags(t: SourceTables, days) -> DataFrame:
    """Per app page view, keyed by terminal type + client + visit + visit order.

    The page-view key is concatenated without separators (a NULL part gives a NULL key, which
    never joins). Grouping by the concatenated key merges tuples that collide on it; since only
    "any click was a favourite / cart" per visitor is used downstream, the result is the same."""
    d = Days.of(days)
    c = d.scan(t.app_click, "trmnl_tp_id", "clnt_id", "visit_id", "visit_order", "click_num")
    key = F.concat("trmnl_tp_id", "clnt_id", "visit_id", "visit_order")
    num = F.col("click_num")
    return c.groupBy(*[F.col(k) for k in d.keys()], key.alias("pv_key")).agg(
        F.max(flag(num.isin(*APP_FAVOURITE_CODES))).alias("p_clct_flag"),
        F.max(flag(num.isin(*APP_CART_CODES))).alias("cart_flag"))


def channel_views(t: SourceTables, days, *cols: str) -> tuple[DataFrame, DataFrame]:
    """Web and app page views of the selected products: what N3 and N4 start from."""
    d = Days.of(days)
    return tuple(t.selected(d.scan(df, *d.keys(*cols)))
                 for df in (t.web_visit, t.app_visit))


def gds_clct_cart(t: SourceTables, days, approx_distinct: bool = False, views: tuple | None = None) -> DataFrame:
    """Distinct visitors with a favourite / cart click, web and app together.

    As in the reference, only the web page views are filtered by business type. Distinct counts are
    two-level: one row per (product, city, visitor) with its flags, then conditional counts. Views without a flag only
    make their product and city have a row, so they are counted without their visitor: one row per (product, city). The
    flags, one row a page view, are the hash side of the joins, so the many views are not sorted. ``views``: the
    shared page views of ``channel_views``."""
    d = Days.of(days)
    cols = d.keys("pv_id", "visitor_id", "city_cd", "gds_id")
    web, app = views or channel_views(t, d, "pv_id", "visitor_id", "city_cd", "gds_id", "busi_tp_id")
    web = web.where(F.col("busi_tp_id").isin(*VISIT_BUSINESS_TYPES)).select(*cols)
    app = app.select(*cols)
    out = [*d.keys(*KEYS), "visitor_id", "p_clct_flag", "cart_flag"]
    web_rows = web.join(web_click_flags(t, d).hint("shuffle_hash"), d.keys("pv_id")).select(*out)
    app_flags = app_click_flags(t, d).withColumnRenamed("pv_key", "pv_id").hint("shuffle_hash")
    app_rows = app.join(app_flags, d.keys("pv_id")).select(*out)
    rows = web_rows.unionByName(app_rows)
    if approx_distinct:  # HyperLogLog sketches per key instead of the per-visitor level
        return rows.groupBy(*d.keys(*KEYS)).agg(
            distinct_count(F.when(F.col("p_clct_flag") == 1, F.col("visitor_id")), True).alias("p_clct_uv_num"),
            distinct_count(F.when(F.col("cart_flag") == 1, F.col("visitor_id")), True).alias("cart_flag_uv_num"))
    flagged = F.when((F.col("p_clct_flag") == 1) | (F.col("cart_flag") == 1), F.col("visitor_id"))
    per_visitor = rows.withColumn("visitor_id", flagged).groupBy(*d.keys(*KEYS, "visitor_id")).agg(
        F.max("p_clct_flag").alias("p"), F.max("cart_flag").alias("c"))
    known = F.col("visitor_id").isNotNull()
    return per_visitor.groupBy(*d.keys(*KEYS)).agg(
        F.count_if(known & (F.col("p") == 1)).alias("p_clct_uv_num"),
        F.count_if(known & (F.col("c") == 1)).alias("cart_flag_uv_num"))
