"""Wide daily feature table (N6): sales at channel 50 left-joined to the four other feature sets."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featuremart.operators.joins import key_bits, reduce_by_bits
from featuremart.plans import clct_cart, search
from featuremart.plans.clct_cart import gds_clct_cart
from featuremart.plans.members import OUTPUT as MEMBER_COLUMNS
from featuremart.plans.members import gds_member
from featuremart.plans.sales import MEASURES as SALES_MEASURES
from featuremart.plans.sales import sales_base, sales_features, with_promotion
from featuremart.plans.search import gds_search
from featuremart.plans.visits import KEYS, LOOKBACK, gds_visit
from featuremart.shared import stage
from featuremart.sources.scans import DAY_COL, Days, range_scan, shift_day
from featuremart.sources.tables import SourceTables

GATHERED_CHANNEL = "50"
VISIT_COLUMNS = ["pv_qty", "visitor_num", "oos_pv_qty", "one_pv_puv_num", "visitors", "old_uv", "loss_rate"]
CART_COLUMNS = ["p_clct_uv_num", "cart_flag_uv_num"]
SEARCH_COLUMNS = ["tot_qty", "search_visit_pv", "search_visit_uv"]
OUTPUT = ["gds_id", "city_cd", "chnl_cd", *SALES_MEASURES, *VISIT_COLUMNS, *CART_COLUMNS, *SEARCH_COLUMNS,
          *MEMBER_COLUMNS]


def _sides(visit, clct_cart, search, member):
    return ((visit, VISIT_COLUMNS), (clct_cart, CART_COLUMNS), (search, SEARCH_COLUMNS), (member, MEMBER_COLUMNS))


def feature_gather(sales: DataFrame, visit: DataFrame, clct_cart: DataFrame, search: DataFrame,
                   member: DataFrame) -> DataFrame:
    """Sales at channel 50 left-joined to the four feature sets on (gds_id, city_cd).

    Every input is unique on the key (each is grouped by it; the sales base is unique once the
    channel is fixed), so the four left joins equal one grouping of the stacked inputs: each input
    contributes its own columns (NULL elsewhere) and a base marker, rows are grouped by the key and
    only keys present in the base are kept. One exchange for all five inputs and a hash
    aggregation (the channel, a text that only sorted groups could carry, is the same in all base rows and
    stays outside), instead of four sort-merge joins. Rows of the feature sets with a NULL key part
    are dropped first: an equi-join never matches them, and the base's NULL-key rows must not pick
    up their values."""
    keys = [DAY_COL, *KEYS] if DAY_COL in sales.columns else list(KEYS)  # day range: per day
    base = sales.where(F.col("chnl_cd") == GATHERED_CHANNEL)
    sides = _sides(visit, clct_cart, search, member)
    all_cols = list(SALES_MEASURES) + [c for _, cols in sides for c in cols]
    types = {f.name: f.dataType for df in (base, visit, clct_cart, search, member) for f in df.schema.fields}

    def stacked(df: DataFrame, own: list[str], is_base: bool) -> DataFrame:
        # one SQL projection per input (cheap to build): own columns as they are, NULL elsewhere
        return df.selectExpr(*[f"`{k}`" for k in keys], f"{str(is_base).upper()} AS __base",
                             *[f"`{c}`" if c in own else f"CAST(NULL AS {types[c].simpleString()}) AS `{c}`"
                               for c in all_cols])

    frames = [stacked(base, SALES_MEASURES, True)]
    for side, cols in sides:
        keyed = side.where(F.col(keys[-2]).isNotNull() & F.col(keys[-1]).isNotNull())
        frames.append(stacked(keyed, cols, False))
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    # each column comes from exactly one input row per key, so max() just picks it (or NULL)
    out = union.groupBy(*keys).agg(F.max("__base").alias("__base"), *[F.max(c).alias(c) for c in all_cols])
    out = out.where(F.col("__base")).withColumn("chnl_cd", F.lit(GATHERED_CHANNEL).cast(types["chnl_cd"]))
    return out.select(*keys[:-2], *OUTPUT)


def feature_gather_joined(sales: DataFrame, visit: DataFrame, clct_cart: DataFrame, search: DataFrame,
                          member: DataFrame) -> DataFrame:
    """N6 literally as the reference writes it: a chain of four left joins (for checks)."""
    keys = [DAY_COL, *KEYS] if DAY_COL in sales.columns else list(KEYS)
    out = sales.where(F.col("chnl_cd") == GATHERED_CHANNEL)
    for side, cols in _sides(visit, clct_cart, search, member):
        out = out.join(side.select(*keys, *cols), keys, "left")
    return out.select(*keys[:-2], *OUTPUT)


CELL = "__cell"


def _cell() -> Column:
    return F.concat_ws("\u0001", *KEYS)


def shared_views(t: SourceTables, days, reduce: Callable[[DataFrame], DataFrame] = lambda df: df
                 ) -> tuple[DataFrame, DataFrame]:
    """Web and app page views of N3 and N4, each read from its source once and written to the shared folder."""
    views = clct_cart.channel_views(t, days, "pv_id", "visitor_id", *search.VISIT_KEYS, "busi_tp_id", "from_key_word")
    with ThreadPoolExecutor(max_workers=len(views)) as pool:
        web, app = pool.map(stage, map(reduce, views), ("web-views", "app-views"))
    return web, app


def shared_inputs(t: SourceTables, days) -> tuple[DataFrame, tuple[DataFrame, DataFrame], DataFrame]:
    """What several of the jobs start from, each read from its source once and written to the shared folder: the order
    lines with the promotion flag (N1, N4, N5), then side by side web and app page views (N3, N4), and the visits from
    the look-back on (N2a, N2b).

    The wide table has the (product, city) of lines sold at the gathered channel, so views and visits of most others are
    left out by a bit table of these keys: bounded, broadcast and without a shuffle. It lets all rows of a sold key through,
    and the few rows of others that pass make features that the gather drops, as before."""
    d = Days.of(days)
    lines = stage(with_promotion(sales_base(t, d), t, d), "order-lines")
    sold = lines.where(F.col("chnl_cd") == GATHERED_CHANNEL).select(_cell().alias(CELL))
    bits = key_bits(sold, CELL)
    size = bits.agg(F.max("size")).first()[0] or 1

    def of_sold(df: DataFrame) -> DataFrame:
        return reduce_by_bits(df.withColumn(CELL, _cell()), CELL, bits, size).drop(CELL)

    visits = range_scan(t.cust_visit, shift_day(d.lo, -LOOKBACK), d.hi, "statis_date", *KEYS, "visitor_id", "visit_id",
                        "busi_tp_id", "pv_qty", "oos_pv_qty", "one_pv_puv_flag")
    visits = t.selected(visits)
    with ThreadPoolExecutor(max_workers=1) as pool:
        staged = pool.submit(stage, of_sold(visits), "visits")
        views = shared_views(t, d, of_sold)
        return lines, views, staged.result()


def feature_gather_for_day(t: SourceTables, days, approx_distinct: bool = False) -> DataFrame:
    """N6 computed from the source tables (the daily runner instead reads the five written day partitions back).
    ``days`` may be a (lo, hi) range: one row set per day. Inputs that jobs share are staged first (``shared_inputs``)."""
    d = Days.of(days)
    a = approx_distinct
    base, views, visits = shared_inputs(t, d)
    staged = t.replace(cust_visit=visits, restricted=["cust_visit"])
    return feature_gather(sales_features(t, d, base=base, approx_distinct=a), gds_visit(staged, d, approx_distinct=a),
                          gds_clct_cart(t, d, a, views), gds_search(t, d, a, base, views), gds_member(t, d, base))
