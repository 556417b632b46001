"""The set of source tables every feature job reads.

In production each table is a catalog table (``spark.table``) partitioned by ``statis_date``;
for tests the same shapes are derived from the TPC-H-like test data (``testdata``). Tables are
resolved lazily, so a job only plans the sources it reads. Column names follow the reference
jobs, lower-cased.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featuremart.operators.joins import bounded_broadcast, key_bits, reduce_by_bits, restrict_to

TABLES = {
    "order": "order lines: statis_date, gds_id, city_cd, chnl_cd, tot_qty, oms_order_item_id, busi_tp_id, rfd_time, "
             "member_id, tot_amnt, shld_amnt, order_time, pay_time, visit_id",
    "goods": "selected products: gds_cd",
    "deal": "deal types: statis_date, order_item_id, promotion_num, deal_type",
    "cust_visit": "visits: statis_date, gds_id, city_cd, visitor_id, visit_id, busi_tp_id, pv_qty, oos_pv_qty, "
                  "one_pv_puv_flag",
    "web_visit": "web page views: statis_date, pv_id, visitor_id, visit_id, city_cd, gds_id, busi_tp_id, "
                 "from_key_word",
    "app_visit": "app page views: same columns as web_visit",
    "web_click": "web clicks: statis_date, pv_id, prmtr_id_1, prmtr_id_2",
    "app_click": "app clicks: statis_date, trmnl_tp_id, clnt_id, visit_id, visit_order, click_num",
    "member": "members (unpartitioned): member_id, mem_lvl, age_range, gender",
}


class SourceTables:
    """Lazily resolved source tables; ``SourceTables(order=df, ...)`` or with loaders."""

    def __init__(self, loaders: dict[str, Callable[[], DataFrame]] | None = None,
                 goods_broadcast_rows: int = 2_000_000, restricted: Iterable[str] = (), bucketed: Iterable[str] = (),
                 **frames: DataFrame):
        unknown = set(frames) | set(loaders or {})
        unknown -= set(TABLES)
        if unknown:
            raise ValueError(f"unknown source tables {sorted(unknown)}")
        self._loaders = dict(loaders or {})
        self._frames = dict(frames)
        # Largest product list (rows) shipped to every task instead of shuffling the fact side.
        self.goods_broadcast_rows = goods_broadcast_rows
        # Tables that hold rows of selected products only.
        self.restricted = frozenset(restricted)
        # Tables stored in buckets of their join key (``sink.write_bucketed``).
        self.bucketed = frozenset(bucketed)
        self._goods_side: DataFrame | None = None
        self._goods_bits: tuple[DataFrame, int] | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._frames:
            if name not in self._loaders:
                raise ValueError(f"source table {name!r} is not bound")
            self._frames[name] = self._loaders[name]()
        return self._frames[name]

    def replace(self, restricted: Iterable[str] = (), **frames: DataFrame) -> "SourceTables":
        loaders = {k: (lambda k=k: getattr(self, k)) for k in TABLES if k not in frames}
        kept = [name for name in self.restricted if name not in frames and "goods" not in frames]
        stored = [name for name in self.bucketed if name not in frames]
        return SourceTables(loaders, self.goods_broadcast_rows, [*kept, *restricted], stored, **frames)

    def with_bucketed(self, **names: str) -> "SourceTables":
        """The same sources, with roles read from catalog tables that are stored in buckets of their join key."""
        spark = SparkSession.active()
        out = self.replace(**{role: spark.table(name) for role, name in names.items()})
        out.bucketed |= set(names)
        return out

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: dict[str, str], **kw) -> "SourceTables":
        return cls({k: (lambda v=v: spark.table(v)) for k, v in names.items()}, **kw)

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: dict[str, str], schemas: dict | None = None,
                   **kw) -> "SourceTables":
        """Parquet folders (daily tables partitioned by ``statis_date``). Give ``schemas`` to keep the
        day key as text; without them the scans turn an inferred numeric day key back into text."""
        schemas = schemas or {}

        def load(role: str, path: str):
            reader = spark.read.schema(schemas[role]) if role in schemas else spark.read
            return reader.parquet(path)
        return cls({k: (lambda k=k, v=v: load(k, v)) for k, v in paths.items()}, **kw)

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, **kw) -> "SourceTables":
        from featuremart.sources import testdata
        return cls(testdata.loaders(spark, sf_dir), **kw)

    def goods_side(self) -> DataFrame:
        """Product keys for the semi joins (J1-J4), broadcast only when the row count is within
        ``goods_broadcast_rows``; otherwise a shuffled semi join. The size check runs once."""
        if self._goods_side is None:
            side = bounded_broadcast(self.goods, self.goods_broadcast_rows)
            if side is self.goods:  # beyond the bound
                bits = key_bits(self.goods, "gds_cd")
                size = bits.agg(F.max("size")).first()[0]
                self._goods_bits = (bits, size or 1)
            self._goods_side = side.select("gds_cd")
        return self._goods_side

    def selected(self, df: DataFrame, col: str = "gds_id") -> DataFrame:
        """The rows of selected products (J1-J3). A product list beyond the broadcast bound is a shuffled semi join; its bit
        table then takes away most other rows before the shuffle."""
        side = self.goods_side()
        if self._goods_bits is not None:
            df = reduce_by_bits(df, col, *self._goods_bits)
        return restrict_to(df, side, col, "gds_cd")
