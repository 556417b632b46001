"""DuckDB oracle SQL for every registered query with a SQL equivalent.

The fixture binding of ``featuremart.sources.testdata`` is restated as CTEs over the raw test
tables; each query then states the job's semantics in plain SQL (semi joins as ``IN``, the
stack-and-sum as UNION ALL + SUM, ranks with window functions). Integer sums are cast to BIGINT,
doubles rounded half-even to 6 decimals with the same
IEEE formula as the Spark side and divisions guarded with ``nullif``, matching the Spark side.
"""

from __future__ import annotations

from featuremart.schemas import CART_FIELDS, MEMBER_FIELDS, SALES_FIELDS, SEARCH_FIELDS, VISIT_FIELDS
from featuremart.plans.clct_cart import (APP_CART_CODES, APP_FAVOURITE_CODES, WEB_CART_P1, WEB_CART_P2, WEB_FAVOURITE_P1,
                                         WEB_FAVOURITE_P2)
from featuremart.plans.members import AGE_COLUMNS, GENDER_COLUMNS, LEVEL_COLUMNS
from featuremart.queries import (DAY, RANGE_HI, RANGE_LO, TOPN, VOLUME_END, VOLUME_MIN_DAYS, VOLUME_RANK_LIMIT,
                                 VOLUME_START)
from featuremart.sources import testdata as td
from featuremart.sources.scans import shift_day


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _day(offset: str) -> str:
    return f"(DATE {_q(td.BASE_DAY)} + CAST({offset} AS INTEGER))"


_LEVEL = " ".join(f"WHEN c_mktsegment = {_q(k)} THEN {_q(v)}" for k, v in td.SEGMENT_LEVEL.items())
_AGE = " ".join(f"WHEN {i} THEN {_q(a)}" for i, a in enumerate(td.AGE_LABELS))

FIXTURES = f"""
fx_goods AS (
  SELECT CAST(p_partkey AS VARCHAR) AS gds_cd FROM part WHERE p_size <= 30),
fx_order AS (
  SELECT strftime({_day('o_orderkey % 30')}, '%Y%m%d') AS statis_date,
         CAST(l_partkey AS VARCHAR) AS gds_id,
         CAST(c_nationkey AS VARCHAR) AS city_cd,
         CASE o_orderstatus WHEN 'F' THEN '50' WHEN 'O' THEN '51' WHEN 'P' THEN '52' END AS chnl_cd,
         CAST(trunc(l_quantity) AS BIGINT) AS tot_qty,
         CAST(l_extendedprice AS DECIMAL(15, 2)) AS tot_amnt,
         CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(15, 2))) AS shld_amnt,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS oms_order_item_id,
         CASE WHEN l_linestatus = 'O' THEN 'Z' WHEN l_linenumber = 7 THEN '-' ELSE 'X' END AS busi_tp_id,
         CAST(o_custkey AS VARCHAR) AS member_id,
         CAST(o_custkey AS VARCHAR) || '_' || CAST(o_orderkey % 30 + 1 AS VARCHAR) AS visit_id,
         strftime({_day('o_orderkey % 30 + CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END')}, '%Y-%m-%d')
           || ' 10:00:00' AS order_time,
         strftime({_day('o_orderkey % 30 + l_linenumber % 2')}, '%Y-%m-%d') || ' 11:00:00' AS pay_time,
         CASE WHEN l_returnflag = 'R'
              THEN strftime({_day('o_orderkey % 30 + l_linenumber % 3')}, '%Y-%m-%d') || ' 12:00:00' END AS rfd_time
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
fx_deal AS (
  SELECT DISTINCT strftime({_day('o_orderkey % 30')}, '%Y%m%d') AS statis_date,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS order_item_id,
         CASE WHEN l_tax <> 0 THEN 'P' || CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR) END AS promotion_num,
         '0' || substr(o_orderpriority, 1, 1) AS deal_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
fx_ev AS (
  SELECT event_id, user_id, event_type, value,
         strftime(ts, '%Y%m%d') AS statis_date,
         CAST(user_id AS VARCHAR) AS visitor_id,
         CAST(user_id AS VARCHAR) || '_' || CAST(dayofmonth(ts) AS VARCHAR) AS visit_id,
         CAST(1 AS BIGINT) AS pv_qty,
         CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS oos_pv_qty,
         CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS one_pv_puv_flag,
         CASE WHEN event_type = 'signup' THEN 'X' WHEN value < 20 THEN '-' ELSE 'Z-SHIP' END AS busi_tp_id,
         CASE WHEN event_type = 'view' THEN '-' ELSE {_q(td.KEYWORD)} END AS from_key_word
  FROM events),
fx_cust_visit AS (
  SELECT fx_ev.*, CAST(l_partkey AS VARCHAR) AS gds_id, CAST(c_nationkey AS VARCHAR) AS city_cd
  FROM fx_ev JOIN orders ON user_id = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
       JOIN customer ON o_custkey = c_custkey),
fx_web_visit AS (
  SELECT statis_date, CAST(event_id AS VARCHAR) AS pv_id, visitor_id, visit_id, city_cd, gds_id, busi_tp_id,
         from_key_word
  FROM fx_cust_visit WHERE event_id % 2 = 0),
fx_app_visit AS (
  SELECT statis_date,
         CAST(event_id % 3 AS VARCHAR) || 'c' || CAST(user_id AS VARCHAR) || 'v' || visit_id || 'o'
           || CAST(event_id AS VARCHAR) AS pv_id,
         visitor_id, visit_id, city_cd, gds_id, busi_tp_id, from_key_word
  FROM fx_cust_visit WHERE event_id % 2 = 1),
fx_web_click AS (
  SELECT statis_date, CAST(event_id AS VARCHAR) AS pv_id,
         CASE event_type WHEN 'click' THEN 'shoucang01' WHEN 'purchase' THEN 'buy01' WHEN 'signup' THEN 'shoucang02'
                         WHEN 'error' THEN 'basic' ELSE 'other' END AS prmtr_id_1,
         CASE event_type WHEN 'click' THEN CASE WHEN value < 30 THEN 'gmq' ELSE 'zzz' END WHEN 'purchase' THEN 'tab'
                         WHEN 'signup' THEN 'shop' WHEN 'error' THEN 'favorite' ELSE 'none' END AS prmtr_id_2
  FROM fx_ev WHERE event_id % 2 = 0
  UNION ALL
  SELECT statis_date, CAST(event_id AS VARCHAR), 'other', 'none' FROM fx_ev WHERE event_id % 2 = 0),
fx_app_click AS (
  SELECT statis_date, CAST(event_id % 3 AS VARCHAR) AS trmnl_tp_id, 'c' || CAST(user_id AS VARCHAR) || 'v' AS clnt_id,
         visit_id, 'o' || CAST(event_id AS VARCHAR) AS visit_order,
         CASE event_type WHEN 'click' THEN '121316' WHEN 'purchase' THEN '121312' WHEN 'error' THEN '1210709'
                         ELSE '0' END AS click_num
  FROM fx_ev WHERE event_id % 2 = 1
  UNION ALL
  SELECT statis_date, CAST(event_id % 3 AS VARCHAR), 'c' || CAST(user_id AS VARCHAR) || 'v', visit_id,
         'o' || CAST(event_id AS VARCHAR), '0'
  FROM fx_ev WHERE event_id % 2 = 1),
fx_member AS (
  SELECT CAST(c_custkey AS VARCHAR) AS member_id,
         CASE WHEN c_nationkey = 0 THEN {_q(td.UNKNOWN_LEVEL)} {_LEVEL} END AS mem_lvl,
         CASE c_nationkey % 10 {_AGE} ELSE {_q(td.UNKNOWN_AGE)} END AS age_range,
         CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'N' END AS gender
  FROM customer)"""


def _with(*ctes: str) -> str:
    parts = [FIXTURES.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n"


GOODS = "(SELECT gds_cd FROM fx_goods)"


def _count(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


_MEMBER_COLS = ",\n         ".join(
    [f"{_count(f't2.mem_lvl = {_q(code)}')} AS {name}" for name, code in LEVEL_COLUMNS]
    + [f"{_count(' AND '.join(f't2.mem_lvl <> {_q(code)}' for _, code in LEVEL_COLUMNS))} AS vn"]
    + [f"{_count(f't2.age_range = {_q(label)}')} AS {name}" for name, label in AGE_COLUMNS]
    + [f"{_count(' AND '.join(f't2.age_range <> {_q(label)}' for _, label in AGE_COLUMNS))} AS ar10"]
    + [f"{_count(f't2.gender = {_q(g)}')} AS {name}" for name, g in GENDER_COLUMNS])


def _day_ctes(day: str) -> dict[str, str]:
    """The CTEs of the daily jobs for one day (d1 = day - 1, d7 = day - 7)."""
    D = _q(day)  # noqa: N806
    D1 = _q(shift_day(day, -1))  # noqa: N806
    D7 = _q(shift_day(day, -7))  # noqa: N806

    SALES_BASE = f"""
    base AS (
      SELECT * FROM fx_order
      WHERE statis_date = {D} AND busi_tp_id IN ('Z', '-') AND gds_id IN {GOODS})"""

    FS01 = """
    fs01 AS (
      SELECT gds_id, city_cd, chnl_cd,
             CAST(SUM(tot_amnt) AS DOUBLE) / CAST(nullif(SUM(tot_qty), 0) AS DOUBLE) AS gds_price,
             CAST(SUM(shld_amnt) AS DOUBLE) / CAST(nullif(SUM(tot_qty), 0) AS DOUBLE) AS sale_price,
             CAST(SUM(tot_qty) AS BIGINT) AS sale_cnt
      FROM base GROUP BY gds_id, city_cd, chnl_cd)"""

    FS02 = f"""
    fs02 AS (
      SELECT gds_id, city_cd, chnl_cd, COUNT(oms_order_item_id) AS sale_promotion_cnt,
             CAST(SUM(tot_qty) AS BIGINT) AS sale_promotion_num
      FROM base
      WHERE regexp_replace(substring(order_time, 1, 10), '-', '', 'g') = statis_date
        AND oms_order_item_id IN (SELECT order_item_id FROM fx_deal
                                  WHERE statis_date = {D} AND promotion_num IS NOT NULL AND deal_type IN ('02', '03'))
      GROUP BY gds_id, city_cd, chnl_cd)"""

    FS03 = """
    fs03 AS (
      SELECT gds_id, city_cd, chnl_cd, CAST(SUM(tot_qty) AS BIGINT) AS goods_rejected_num
      FROM base WHERE strftime(TRY_CAST(rfd_time AS DATE), '%Y%m%d') = statis_date
      GROUP BY gds_id, city_cd, chnl_cd)"""

    FS04 = """
    fs04 AS (
      SELECT gds_id, city_cd, chnl_cd, COUNT(DISTINCT member_id) AS sale_member_num
      FROM base WHERE regexp_replace(substring(pay_time, 1, 10), '-', '', 'g') = statis_date
      GROUP BY gds_id, city_cd, chnl_cd)"""

    SAL_FS = f"""
    sal_fs AS (
      SELECT gds_id, city_cd, chnl_cd,
             CAST(SUM(sale_cnt) AS BIGINT) AS sale_cnt,
             CAST(SUM(sale_promotion_cnt) AS BIGINT) AS sale_promotion_cnt,
             CAST(SUM(sale_promotion_num) AS BIGINT) AS sale_promotion_num,
             CAST(SUM(goods_rejected_num) AS BIGINT) AS goods_rejected_num,
             CAST(SUM(sale_member_num) AS BIGINT) AS sale_member_num,
             SUM(gds_price) AS gds_price,
             SUM(sale_price) AS sale_price
      FROM (
        SELECT gds_id, city_cd, chnl_cd, sale_cnt, 0 AS sale_promotion_cnt, 0 AS sale_promotion_num,
               0 AS goods_rejected_num, 0 AS sale_member_num, gds_price, sale_price FROM fs01
        UNION ALL
        SELECT gds_id, city_cd, chnl_cd, 0, sale_promotion_cnt, sale_promotion_num, 0, 0, 0, 0 FROM fs02
        UNION ALL
        SELECT gds_id, city_cd, chnl_cd, 0, 0, 0, goods_rejected_num, 0, 0, 0 FROM fs03
        UNION ALL
        SELECT gds_id, city_cd, chnl_cd, 0, 0, 0, 0, sale_member_num, 0, 0 FROM fs04) tt
      GROUP BY gds_id, city_cd, chnl_cd)"""

    VISIT_A = f"""
    visit_a AS (
      SELECT gds_id, city_cd,
             CAST(SUM(pv_qty) AS BIGINT) AS pv_qty,
             COUNT(DISTINCT visitor_id) AS visitor_num,
             CAST(SUM(oos_pv_qty) AS BIGINT) AS oos_pv_qty,
             COUNT(DISTINCT CASE WHEN one_pv_puv_flag = 1 THEN visit_id END) AS one_pv_puv_num,
             COUNT(DISTINCT visit_id) AS visitors
      FROM fx_cust_visit
      WHERE statis_date = {D} AND busi_tp_id IN ('Z-SHIP', '-') AND gds_id <> '-' AND gds_id IN {GOODS}
      GROUP BY gds_id, city_cd)"""

    VISIT_D = f"""
    visit_d AS (
      SELECT gds_id, city_cd,
             CAST(SUM(CASE WHEN old_visitor <> 0 AND new_visitor <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS old_uv
      FROM (
        SELECT gds_id, city_cd, visitor_id,
               MAX(CASE WHEN statis_date BETWEEN {D7} AND {D1} THEN 1 ELSE 0 END) AS old_visitor,
               MAX(CASE WHEN statis_date = {D} THEN 1 ELSE 0 END) AS new_visitor
        FROM fx_cust_visit
        WHERE statis_date BETWEEN {D7} AND {D} AND gds_id <> '-' AND busi_tp_id IN ('Z-SHIP', '-')
          AND gds_id IN {GOODS}
        GROUP BY gds_id, city_cd, visitor_id) t
      GROUP BY gds_id, city_cd)"""

    GDS_VISIT = """
    gds_visit AS (
      SELECT a.gds_id, a.city_cd, a.pv_qty, a.visitor_num, a.oos_pv_qty, a.one_pv_puv_num, a.visitors, d.old_uv,
             CAST(a.one_pv_puv_num AS DOUBLE) / nullif(CAST(a.visitors AS DOUBLE), 0) AS loss_rate
      FROM visit_a a LEFT JOIN visit_d d ON a.gds_id = d.gds_id AND a.city_cd = d.city_cd)"""

    WEB_FLAGS = f"""
    web_flags AS (
      SELECT pv_id,
             MAX(CASE WHEN prmtr_id_1 IN {_in(WEB_FAVOURITE_P1)} AND prmtr_id_2 IN {_in(WEB_FAVOURITE_P2)}
                      THEN 1 ELSE 0 END) AS p_clct_flag,
             MAX(CASE WHEN prmtr_id_1 IN {_in(WEB_CART_P1)} AND prmtr_id_2 IN {_in(WEB_CART_P2)}
                      THEN 1 ELSE 0 END) AS cart_flag
      FROM fx_web_click WHERE statis_date = {D} GROUP BY pv_id)"""

    APP_FLAGS = f"""
    app_flags AS (
      SELECT trmnl_tp_id || clnt_id || visit_id || visit_order AS pv_key,
             MAX(CASE WHEN click_num IN {_in(APP_FAVOURITE_CODES)} THEN 1 ELSE 0 END) AS p_clct_flag,
             MAX(CASE WHEN click_num IN {_in(APP_CART_CODES)} THEN 1 ELSE 0 END) AS cart_flag
      FROM fx_app_click WHERE statis_date = {D}
      GROUP BY trmnl_tp_id || clnt_id || visit_id || visit_order)"""

    CLCT_CART = f"""
    clct_cart AS (
      SELECT gds_id, city_cd,
             COUNT(DISTINCT CASE WHEN p_clct_flag = 1 THEN visitor_id END) AS p_clct_uv_num,
             COUNT(DISTINCT CASE WHEN cart_flag = 1 THEN visitor_id END) AS cart_flag_uv_num
      FROM (
        SELECT t1.visitor_id, t1.city_cd, t1.gds_id, t2.p_clct_flag, t2.cart_flag
        FROM (SELECT * FROM fx_web_visit WHERE statis_date = {D} AND busi_tp_id IN ('Z-SHIP', '-')
                                           AND gds_id IN {GOODS}) t1
        JOIN web_flags t2 ON t1.pv_id = t2.pv_id
        UNION ALL
        SELECT t1.visitor_id, t1.city_cd, t1.gds_id, t2.p_clct_flag, t2.cart_flag
        FROM (SELECT * FROM fx_app_visit WHERE statis_date = {D} AND gds_id IN {GOODS}) t1
        JOIN app_flags t2 ON t1.pv_id = t2.pv_key) t
      GROUP BY gds_id, city_cd)"""


    def _channel_search(table: str) -> str:
        return f"""
        SELECT gds_id, visit_id, city_cd, COUNT(pv_id) AS search_visit_pv, COUNT(DISTINCT visitor_id) AS search_visit_uv
        FROM {table}
        WHERE statis_date = {D} AND from_key_word <> '-' AND gds_id <> '' AND gds_id <> '-' AND visit_id <> '-'
          AND visit_id <> '' AND city_cd <> '-' AND city_cd <> '' AND busi_tp_id IN ('Z-SHIP', '-')
          AND gds_id IN {GOODS}
        GROUP BY gds_id, city_cd, visit_id"""


    SEARCH_VISITS = f"""
    search_visits AS (
      SELECT gds_id, city_cd, visit_id, CAST(SUM(search_visit_pv) AS BIGINT) AS search_visit_pv,
             CAST(SUM(search_visit_uv) AS BIGINT) AS search_visit_uv
      FROM ({_channel_search('fx_app_visit')}
        UNION ALL {_channel_search('fx_web_visit')}) t
      GROUP BY gds_id, city_cd, visit_id)"""

    GDS_SEARCH = f"""
    gds_search AS (
      SELECT t1.gds_id, t1.city_cd, CAST(SUM(t1.tot_qty) AS BIGINT) AS tot_qty,
             CAST(SUM(t2.search_visit_pv) AS BIGINT) AS search_visit_pv,
             CAST(SUM(t2.search_visit_uv) AS BIGINT) AS search_visit_uv
      FROM (SELECT gds_id, city_cd, visit_id, tot_qty FROM fx_order
            WHERE statis_date = {D} AND gds_id <> '-' AND visit_id <> '-' AND busi_tp_id IN ('Z', '-')
              AND gds_id IN {GOODS}) t1
      JOIN search_visits t2 ON t1.gds_id = t2.gds_id AND t1.city_cd = t2.city_cd AND t1.visit_id = t2.visit_id
      GROUP BY t1.gds_id, t1.city_cd)"""


    GDS_MEMBER = f"""
    gds_member AS (
      SELECT t1.gds_id, t1.city_cd, COUNT(t2.member_id) AS members,
             {_MEMBER_COLS}
      FROM (SELECT gds_id, city_cd, member_id FROM fx_order
            WHERE statis_date = {D} AND busi_tp_id IN ('Z', '-') AND gds_id IN {GOODS}
            GROUP BY gds_id, city_cd, member_id) t1
      JOIN fx_member t2 ON t1.member_id = t2.member_id
      GROUP BY t1.gds_id, t1.city_cd)"""
    names = ["SALES_BASE", "FS01", "FS02", "FS03", "FS04", "SAL_FS", "VISIT_A", "VISIT_D", "GDS_VISIT", "WEB_FLAGS",
             "APP_FLAGS", "CLCT_CART", "SEARCH_VISITS", "GDS_SEARCH", "GDS_MEMBER"]
    scope = locals()
    return {n: scope[n] for n in names}


MEMBER_OUT = ["members"] + [n for n, _ in LEVEL_COLUMNS] + ["vn"] + [n for n, _ in AGE_COLUMNS] + ["ar10"] + \
    [n for n, _ in GENDER_COLUMNS]


PAID_DAYS = f"""
paid AS (
  SELECT gds_id, statis_date, CAST(SUM(tot_qty) AS BIGINT) AS "sum"
  FROM fx_order
  WHERE statis_date >= {_q(VOLUME_START)} AND statis_date <= {_q(VOLUME_END)}
    AND regexp_replace(substr(pay_time, 1, 10), '-', '', 'g') = statis_date
  GROUP BY gds_id, statis_date),
volume AS (
  SELECT gds_id, statis_date, "sum", COUNT(*) OVER (PARTITION BY gds_id) AS num,
         CAST(SUM("sum") OVER (PARTITION BY gds_id) AS BIGINT) AS sales_volume
  FROM paid)"""


def _r6(expr: str) -> str:
    """Same half-even rounding to 6 decimals as ``featuremart.queries.round6``."""
    return f"(round_even(({expr}) * 1e6, 0) / 1e6)"


GATHER_COLS = ["gds_id", "city_cd", "chnl_cd", "sale_cnt", "sale_promotion_cnt", "sale_promotion_num",
               "goods_rejected_num", "sale_member_num", "gds_price", "sale_price", "pv_qty", "visitor_num",
               "oos_pv_qty", "one_pv_puv_num", "visitors", "old_uv", "loss_rate", "p_clct_uv_num",
               "cart_flag_uv_num", "tot_qty", "search_visit_pv", "search_visit_uv", *MEMBER_OUT]


def _gather_select() -> str:
    src = {c: "a" for c in GATHER_COLS[:10]}
    src.update({c: "b" for c in ["pv_qty", "visitor_num", "oos_pv_qty", "one_pv_puv_num", "visitors", "old_uv",
                                 "loss_rate"]})
    src.update({"p_clct_uv_num": "c", "cart_flag_uv_num": "c", "tot_qty": "d", "search_visit_pv": "d",
                "search_visit_uv": "d"})
    src.update({c: "e" for c in MEMBER_OUT})
    doubles = {"gds_price", "sale_price", "loss_rate"}
    return ", ".join(f"{_r6(src[c] + '.' + c)} AS {c}" if c in doubles else f"{src[c]}.{c}" for c in GATHER_COLS)


def _daily_queries(day: str) -> dict[str, str]:
    """Oracle SQL of the jobs that read one day, for ``day``."""
    c = _day_ctes(day)
    sales_ctes = [c[n] for n in ("SALES_BASE", "FS01", "FS02", "FS03", "FS04", "SAL_FS")]
    visit_ctes = [c[n] for n in ("VISIT_A", "VISIT_D", "GDS_VISIT")]
    price = f"{_r6('gds_price')} AS gds_price, {_r6('sale_price')} AS sale_price"
    return {
        "sal_price": _with(c["SALES_BASE"], c["FS01"]) + f"SELECT gds_id, city_cd, chnl_cd, {price}, sale_cnt FROM fs01",
        "sal_promotion": _with(c["SALES_BASE"], c["FS02"]) + "SELECT * FROM fs02",
        "sal_rejected": _with(c["SALES_BASE"], c["FS03"]) + "SELECT * FROM fs03",
        "sal_members": _with(c["SALES_BASE"], c["FS04"]) + "SELECT * FROM fs04",
        "sal_fs": _with(*sales_ctes) +
        "SELECT gds_id, city_cd, chnl_cd, sale_cnt, sale_promotion_cnt, sale_promotion_num, goods_rejected_num, "
        f"sale_member_num, {price} FROM sal_fs",
        "sal_fs_target": _with(*sales_ctes) +
        "SELECT gds_id AS gds_cd, city_cd, chnl_cd, CAST(sale_cnt AS INTEGER) AS sale_cnt, CAST(sale_promotion_cnt AS "
        "INTEGER) AS sale_promotion_cnt, CAST(sale_promotion_num AS INTEGER) AS sale_promotion_num, CAST(goods_rejected_num "
        f"AS DOUBLE) AS goods_rejected_num, CAST(sale_member_num AS DOUBLE) AS sale_member_num, {price}, {_q(day)} AS "
        "statis_date FROM sal_fs",
        "gds_search_target": _with(c["SEARCH_VISITS"], c["GDS_SEARCH"]) +
        "SELECT gds_id, city_cd, CAST(tot_qty AS INTEGER) AS tot_qty, CAST(search_visit_pv AS INTEGER) AS search_visit_pv, "
        f"CAST(search_visit_uv AS INTEGER) AS search_visit_uv, {_q(day)} AS statis_date FROM gds_search",
        "visit_measures": _with(c["VISIT_A"]) + "SELECT * FROM visit_a",
        "returning_visitors": _with(c["VISIT_D"]) + "SELECT * FROM visit_d",
        "gds_visit": _with(*visit_ctes) +
        "SELECT gds_id, city_cd, pv_qty, visitor_num, oos_pv_qty, one_pv_puv_num, visitors, old_uv, "
        f"{_r6('loss_rate')} AS loss_rate FROM gds_visit",
        "web_click_flags": _with(c["WEB_FLAGS"]) + "SELECT * FROM web_flags",
        "app_click_flags": _with(c["APP_FLAGS"]) + "SELECT * FROM app_flags",
        "gds_clct_cart": _with(c["WEB_FLAGS"], c["APP_FLAGS"], c["CLCT_CART"]) + "SELECT * FROM clct_cart",
        "search_visits": _with(c["SEARCH_VISITS"]) + "SELECT * FROM search_visits",
        "gds_search": _with(c["SEARCH_VISITS"], c["GDS_SEARCH"]) + "SELECT * FROM gds_search",
        "gds_member": _with(c["GDS_MEMBER"]) + "SELECT * FROM gds_member",
        "gds_member_bucketed": _with(c["GDS_MEMBER"]) + "SELECT * FROM gds_member",
        "feature_gather": _with(*sales_ctes, *visit_ctes, c["WEB_FLAGS"], c["APP_FLAGS"], c["CLCT_CART"],
                                c["SEARCH_VISITS"], c["GDS_SEARCH"], c["GDS_MEMBER"]) +
        f"SELECT {_gather_select()} FROM (SELECT * FROM sal_fs WHERE chnl_cd = '50') a "
        "LEFT JOIN gds_visit b ON a.gds_id = b.gds_id AND a.city_cd = b.city_cd "
        "LEFT JOIN clct_cart c ON a.gds_id = c.gds_id AND a.city_cd = c.city_cd "
        "LEFT JOIN gds_search d ON a.gds_id = d.gds_id AND a.city_cd = d.city_cd "
        "LEFT JOIN gds_member e ON a.gds_id = e.gds_id AND a.city_cd = e.city_cd",
    }


RANGE_JOBS = ["sal_fs", "gds_visit", "gds_clct_cart", "gds_search", "gds_member", "feature_gather"]


def _days(lo: str, hi: str) -> list[str]:
    out, d = [], lo
    while d <= hi:
        out.append(d)
        d = shift_day(d, 1)
    return out


def _range_queries(lo: str, hi: str) -> dict[str, str]:
    """A job over a day range equals the union of its daily results, each tagged with its day."""
    per_day = {day: _daily_queries(day) for day in _days(lo, hi)}
    return {f"{name}_range": "\nUNION ALL\n".join(
        f"SELECT {_q(day)} AS statis_date, q{i}.* FROM ({qs[name]}) q{i}" for i, (day, qs) in enumerate(per_day.items()))
        for name in RANGE_JOBS}


def _median_sql(col: str) -> str:
    return f"SELECT l_returnflag, {_r6(f'quantile_cont({col}, 0.5)')} AS median FROM lineitem GROUP BY l_returnflag"


def _as_target(query: str, keys: list[str], fields: list) -> str:
    kinds = {"integer": "INTEGER", "double": "DOUBLE", "float": "FLOAT"}
    cols = []
    for name, kind in fields:
        cast = f'CAST("{name}" AS {kinds[kind.typeName()]})'
        cols.append(f"{cast if kind.typeName() == 'integer' else _r6(f'CAST({cast} AS DOUBLE)')} AS \"{name}\"")
    return f"SELECT {', '.join(keys)}, {', '.join(cols)}, {_q(DAY)} AS statis_date FROM ({query}) result"


def sql() -> dict[str, str]:
    out = _daily_queries(DAY)
    out.update(_range_queries(RANGE_LO, RANGE_HI))
    out.update({
        "returning_visitors_range": _with() + _returning_range_sql(),
        "sales_volume": _with(PAID_DAYS) +
        f'SELECT gds_id, statis_date, "sum", num, sales_volume FROM volume WHERE num > {VOLUME_MIN_DAYS}',
        "sales_volume_rank": _with(PAID_DAYS) +
        f'SELECT * FROM (SELECT gds_id, statis_date, "sum", num, sales_volume, '
        f'CAST(rank() OVER (ORDER BY num DESC, sales_volume DESC) AS INTEGER) AS "rank" '
        f'FROM volume WHERE num > {VOLUME_MIN_DAYS}) r WHERE "rank" < {VOLUME_RANK_LIMIT}',
        "sales_volume_dense_rank": _with(PAID_DAYS) +
        f'SELECT * FROM (SELECT gds_id, statis_date, "sum", num, sales_volume, '
        f'CAST(dense_rank() OVER (ORDER BY num DESC, sales_volume DESC) AS INTEGER) AS "rank" '
        f'FROM volume WHERE num > {VOLUME_MIN_DAYS}) r WHERE "rank" < {VOLUME_RANK_LIMIT}',
        "sales_volume_rank_all": _with(PAID_DAYS) +
        'SELECT gds_id, statis_date, "sum", num, sales_volume, '
        'rank() OVER (ORDER BY num DESC, sales_volume DESC) AS "rank" FROM volume WHERE num > 0',
        "order_line_rank": 'SELECT l_orderkey, l_linenumber, CAST(r AS INTEGER) AS "rank" FROM (SELECT *, rank() OVER '
        '(ORDER BY l_extendedprice DESC, l_quantity DESC) AS r FROM lineitem) t WHERE r < 2000000',
        "adhoc_filter_limit": _with(_TB) + "SELECT a, b, c FROM tb WHERE a = '' AND b = '' ORDER BY c LIMIT 10",
        "greeting": "SELECT c_custkey, 'Hello ' || c_name AS greeting FROM customer",
        "array_contains_strict": "SELECT p_partkey, list_contains(string_split(p_name, ' '), 'red') AS has_red "
                                 "FROM part",
        "total_score": "SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS name, "
                       "CAST(SUM(CAST(trunc(l_quantity) AS INTEGER) + l_linenumber) AS BIGINT) AS total_score "
                       "FROM lineitem GROUP BY l_orderkey",
        "name_rows": _NAME_ROWS,
        "name_rows_sql": _NAME_ROWS,
        "max_any": f"SELECT l_returnflag, MAX(l_linenumber) AS max_int, MAX(l_suppkey) AS max_long, "
                   f"{_r6('MAX(l_extendedprice)')} AS max_double, MAX(l_linestatus) AS max_string, "
                   "strftime(MAX(l_shipdate), '%Y-%m-%d %H:%M:%S') AS max_ts FROM lineitem GROUP BY l_returnflag",
        "max_min": f"SELECT l_returnflag, {_r6('MAX(l_extendedprice)')} AS price_max, "
                   f"{_r6('MIN(l_extendedprice)')} AS price_min, CAST(MAX(l_linenumber) AS DOUBLE) AS line_max, "
                   "CAST(MIN(l_linenumber) AS DOUBLE) AS line_min FROM lineitem GROUP BY l_returnflag",
        "max_min_text": "SELECT l_returnflag, CAST(MAX(l_quantity) AS VARCHAR) || chr(9) || CAST(MIN(l_quantity) AS VARCHAR) "
                        f"AS quantity, {_r6('epoch_us(MAX(l_shipdate)) / 1e6')} AS ship_max, "
                        f"{_r6('epoch_us(MIN(l_shipdate)) / 1e6')} AS ship_min FROM lineitem GROUP BY l_returnflag",
        "median_null_groups": f"SELECT nullif(l_returnflag, 'N') AS flag, {_r6('quantile_cont(price, 0.5)')} AS median "
                              "FROM (SELECT l_returnflag, CASE WHEN l_returnflag <> 'A' THEN l_extendedprice END AS price "
                              "FROM lineitem) GROUP BY 1",
        "sql_functions": "SELECT 'Hello o' || CAST(l_orderkey AS VARCHAR) AS greeting, l_orderkey = 1 AS is_o1, "
                         "CAST(trunc(l_quantity) AS BIGINT) + l_linenumber AS total_score FROM lineitem",
        "median_int": _median_sql("l_linenumber"),
        "median_long": _median_sql("l_suppkey"),
        "median_double": _median_sql("l_extendedprice"),
        "letters_total": "SELECT lang, CAST(COALESCE(SUM(length(text)), 0) AS BIGINT) AS letters FROM documents "
                         "GROUP BY lang",
        "topn_rows": f"SELECT * FROM (SELECT l_suppkey, l_extendedprice, l_orderkey, l_linenumber, "
                     f"CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, "
                     f"l_linenumber) AS INTEGER) AS rn FROM lineitem WHERE l_extendedprice IS NOT NULL) t "
                     f"WHERE rn <= {TOPN}",
        "topn_array": f"""
WITH ranked AS (
  SELECT l_suppkey, l_extendedprice, l_orderkey, l_linenumber,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn
  FROM lineitem WHERE l_extendedprice IS NOT NULL),
slots AS (SELECT s.l_suppkey, CAST(p.pos AS INTEGER) AS pos
          FROM (SELECT DISTINCT l_suppkey FROM ranked) s, range(1, {TOPN} + 1) p(pos))
SELECT s.l_suppkey, s.pos, r.l_extendedprice AS f0, r.l_orderkey AS f1, r.l_linenumber AS f2
FROM slots s LEFT JOIN ranked r ON r.l_suppkey = s.l_suppkey AND r.rn = s.pos""",
        "dau_count": _DAU,
    })
    # results as the sinks write them: declared types, the day as a column
    for name, fields in (("gds_visit", VISIT_FIELDS), ("gds_clct_cart", CART_FIELDS), ("gds_member", MEMBER_FIELDS)):
        out[f"{name}_target"] = _as_target(out[name], ["gds_id", "city_cd"], fields)
    out["feature_gather_published"] = _as_target(
        out["feature_gather"], ["gds_id", "city_cd", "chnl_cd"],
        [*SALES_FIELDS, *VISIT_FIELDS, *CART_FIELDS, *SEARCH_FIELDS, *MEMBER_FIELDS])
    out["dau_bitmaps"] = out["dau_count"]
    out["dau_period"] = _DAU_PERIOD
    out["period_visitors"] = _with() + (
        "SELECT gds_id, city_cd, count(DISTINCT visitor_id) AS visitor_num FROM fx_cust_visit WHERE statis_date BETWEEN "
        f"{_q(RANGE_LO)} AND {_q(RANGE_HI)} AND busi_tp_id IN ('Z-SHIP', '-') AND gds_id <> '-' AND gds_id IN "
        f"{GOODS} GROUP BY gds_id, city_cd")
    # other plans of the same results
    out["returning_visitors_state"] = out["returning_visitors"]
    out["sales_volume_store"] = out["sales_volume"]
    out["sales_volume_rank_store"] = out["sales_volume_rank"]
    return out


def _returning_range_sql() -> str:
    return f"""
SELECT statis_date, gds_id, city_cd, CAST(SUM(old_uv) AS BIGINT) AS old_uv FROM (
SELECT strftime(strptime(s.statis_date, '%Y%m%d') + k * INTERVAL 1 DAY, '%Y%m%d') AS statis_date, gds_id, city_cd, 0 AS old_uv
FROM (SELECT DISTINCT statis_date, gds_id, city_cd FROM fx_cust_visit
      WHERE busi_tp_id IN ('Z-SHIP', '-') AND gds_id <> '-' AND gds_id IN {GOODS}) s, range(0, 8) r(k)
UNION ALL
SELECT d.statis_date, d.gds_id, d.city_cd,
       CAST(SUM(CASE WHEN EXISTS (
            SELECT 1 FROM fx_cust_visit p
            WHERE p.gds_id = d.gds_id AND p.city_cd = d.city_cd AND p.visitor_id = d.visitor_id
              AND p.busi_tp_id IN ('Z-SHIP', '-') AND p.gds_id IN {GOODS}
              AND p.statis_date < d.statis_date
              AND p.statis_date >= strftime(strptime(d.statis_date, '%Y%m%d') - INTERVAL 7 DAY, '%Y%m%d'))
           THEN 1 ELSE 0 END) AS BIGINT) AS old_uv
FROM (SELECT DISTINCT statis_date, gds_id, city_cd, visitor_id FROM fx_cust_visit
      WHERE statis_date BETWEEN {_q(RANGE_LO)} AND {_q(RANGE_HI)} AND busi_tp_id IN ('Z-SHIP', '-')
        AND gds_id <> '-' AND gds_id IN {GOODS}) d
GROUP BY d.statis_date, d.gds_id, d.city_cd)
WHERE statis_date BETWEEN {_q(RANGE_LO)} AND {_q(RANGE_HI)} GROUP BY 1, 2, 3"""


_TB = """
tb AS (
  SELECT CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS a,
         CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END AS b,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS c
  FROM lineitem)"""

_NAME_ROWS = r"""
WITH n AS (
  SELECT p_partkey,
         CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_type || ' and ' || p_name
                            WHEN 3 THEN p_name || ' ' || p_name END AS full_name
  FROM part),
t AS (
  SELECT p_partkey, full_name, regexp_split_to_array(regexp_replace(full_name, '\s+$', ''), '\s+') AS tk FROM n
  WHERE full_name IS NOT NULL AND full_name <> '')
SELECT p_partkey, tk[1] AS name, tk[2] AS surname FROM t WHERE len(tk) = 2
UNION ALL
SELECT p_partkey, tk[1] AS name, tk[4] AS surname FROM t WHERE len(tk) = 4 AND tk[2] = 'and'
UNION ALL
SELECT p_partkey, tk[3] AS name, tk[4] AS surname FROM t WHERE len(tk) = 4 AND tk[2] = 'and'"""

_DAU_ROWS = """
WITH e AS (
  SELECT strftime(ts, '%Y%m%d') AS statis_date,
         CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS flag,
         'u' || CAST(user_id AS VARCHAR) AS uid,
         'i' || CAST(user_id * 3 + event_id % 3 AS VARCHAR) AS imei
  FROM events)"""

_DAU_PERIOD = _DAU_ROWS + """
SELECT (SELECT COUNT(DISTINCT uid) FROM e WHERE flag = 1)
       + (SELECT COUNT(DISTINCT imei) FROM e WHERE flag <> 1 AND imei NOT IN (SELECT imei FROM e WHERE flag = 1)) AS dau"""

_DAU = _DAU_ROWS + """,
logged AS (SELECT statis_date, COUNT(DISTINCT uid) AS n FROM e WHERE flag = 1 GROUP BY statis_date),
anon AS (SELECT statis_date, COUNT(DISTINCT imei) AS n FROM e WHERE flag <> 1 GROUP BY statis_date),
both_ AS (SELECT statis_date, COUNT(*) AS n FROM (
            SELECT statis_date, imei FROM e GROUP BY statis_date, imei
            HAVING MAX(flag = 1) AND MAX(flag <> 1)) x GROUP BY statis_date),
days AS (SELECT DISTINCT statis_date FROM e)
SELECT d.statis_date,
       CAST(COALESCE(l.n, 0) + COALESCE(a.n, 0) - COALESCE(b.n, 0) AS BIGINT) AS dau
FROM days d LEFT JOIN logged l USING (statis_date) LEFT JOIN anon a USING (statis_date)
     LEFT JOIN both_ b USING (statis_date)"""
