"""Target table schemas (K1). Counts are computed as 64-bit and cast to the declared INT only
here; FLOAT columns are computed in double. Every target is partitioned by ``statis_date``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

S, I, D, FL = T.StringType(), T.IntegerType(), T.DoubleType(), T.FloatType()

MEMBER_FIELDS = [(c, I) for c in ["members", "new", "v3", "v2", "v1", "orther", "vn", "ar1", "ar2", "ar3", "ar4",
                                  "ar5", "ar6", "ar7", "ar8", "ar9", "ar10", "f", "m", "n"]]
SALES_FIELDS = [("sale_cnt", I), ("sale_promotion_cnt", I), ("sale_promotion_num", I), ("goods_rejected_num", D),
                ("sale_member_num", D), ("gds_price", D), ("sale_price", D)]
VISIT_FIELDS = [("pv_qty", I), ("visitor_num", I), ("oos_pv_qty", I), ("one_pv_puv_num", I), ("visitors", I),
                ("old_uv", I), ("loss_rate", FL)]
CART_FIELDS = [("p_clct_uv_num", I), ("cart_flag_uv_num", I)]
SEARCH_FIELDS = [("tot_qty", I), ("search_visit_pv", I), ("search_visit_uv", I)]
ETL = [("etl_time", S)]


@dataclass(frozen=True)
class Target:
    name: str
    fields: list[tuple[str, T.DataType]]
    # job column -> target column, for the columns whose names differ (never by position)
    renames: dict[str, str] = field(default_factory=dict)
    partition: str = "statis_date"

    @property
    def schema(self) -> T.StructType:
        part = [T.StructField(self.partition, S)] if self.partition else []
        return T.StructType([T.StructField(n, t) for n, t in self.fields] + part)


SALES_T = Target("sales_features_d", [("gds_cd", S), ("city_cd", S), ("chnl_cd", S), *SALES_FIELDS],
                renames={"gds_id": "gds_cd"})
VISITS_T = Target("visit_features_d", [("gds_id", S), ("city_cd", S), *VISIT_FIELDS, *ETL])
FAVOURITE_CART_T = Target("favourite_cart_d", [("gds_id", S), ("city_cd", S), *CART_FIELDS, *ETL])
SEARCH_T = Target("search_features_d", [("gds_id", S), ("city_cd", S), *SEARCH_FIELDS, *ETL])
MEMBERS_T = Target("member_features_d", [("gds_id", S), ("city_cd", S), *MEMBER_FIELDS, *ETL])
GATHER_T = Target("product_features_d",
                       [("gds_id", S), ("city_cd", S), ("chnl_cd", S), *SALES_FIELDS, *VISIT_FIELDS, *CART_FIELDS,
                        *SEARCH_FIELDS, *MEMBER_FIELDS, *ETL])
SALES_VOLUME_T = Target("sales_volume_stats",
                      [("gds_id", S), ("statis_date", S), ("sum", T.LongType()), ("num", T.LongType()),
                       ("sales_volume", T.LongType()), ("rank", I)], partition="")

# State kept between daily runs: bit k of ``days``: the visitor came k days before; quantity per product and paid day.
VISIT_DAYS_T = Target("visit_days_d", [("gds_id", S), ("city_cd", S), ("visitor_id", S), ("days", T.LongType())])
PAID_QUANTITY_T = Target("paid_quantity_d", [("gds_id", S), ("sum", T.LongType())])

TARGETS = {t.name: t for t in [SALES_T, VISITS_T, FAVOURITE_CART_T, SEARCH_T, MEMBERS_T, GATHER_T, SALES_VOLUME_T,
                               VISIT_DAYS_T, PAID_QUANTITY_T]}
DAILY = [SALES_T, VISITS_T, FAVOURITE_CART_T, SEARCH_T, MEMBERS_T, GATHER_T]
