"""Sinks and the daily runner: typed targets, idempotent day overwrite, gather from written days."""

import pytest
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from featuremart import schemas, sink
from featuremart.plans import daily, gather
from featuremart.queries import DAY
from featuremart.sources import SourceTables


def test_day_overwrite_is_idempotent_and_keeps_other_days(spark):
    out = tempfile.mkdtemp(prefix="fm-sink-", dir="/tmp")
    df1 = spark.createDataFrame([("g1", "c", 1, 2)], "gds_id string, city_cd string, p_clct_uv_num bigint, "
                                                     "cart_flag_uv_num bigint")
    df2 = spark.createDataFrame([("g2", "c", 3, 4)], "gds_id string, city_cd string, p_clct_uv_num bigint, "
                                                     "cart_flag_uv_num bigint")
    sink.write_day(df1, schemas.FAVOURITE_CART_T, "20240101", path=out)
    sink.write_day(df2, schemas.FAVOURITE_CART_T, "20240102", path=out)
    sink.write_day(df2, schemas.FAVOURITE_CART_T, "20240101", path=out)  # re-run replaces only that day
    back = spark.read.schema(schemas.FAVOURITE_CART_T.schema).parquet(out)
    assert rows(back.select("gds_id", "statis_date")) == [("g2", "20240101"), ("g2", "20240102")]
    assert dict(back.dtypes)["p_clct_uv_num"] == "int"
    assert back.where(F.col("etl_time").rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")).count() == 2


def test_conform_renames_by_name_not_position(spark):
    df = spark.createDataFrame([(1, "c", "50", "g")], "sale_cnt bigint, city_cd string, chnl_cd string, gds_id string")
    df = df.select("gds_id", "city_cd", "chnl_cd", "sale_cnt", *[F.lit(0).alias(c) for c in
                   ["sale_promotion_cnt", "sale_promotion_num", "goods_rejected_num", "sale_member_num"]],
                   F.lit(None).cast("double").alias("gds_price"), F.lit(1.5).alias("sale_price"))
    out = sink.conform(df.select(*reversed(df.columns)), schemas.SALES_T, DAY).collect()[0]
    assert out.gds_cd == "g" and out.sale_cnt == 1 and out.sale_price == 1.5 and out.statis_date == DAY


def test_daily_run_gathers_from_written_partitions(spark):
    out = tempfile.mkdtemp(prefix="fm-daily-", dir="/tmp")
    t = SourceTables.from_testdata(spark, SF_SMALL)
    paths = daily.run_day(spark, t, DAY, out)
    written = sink.read_day(spark, schemas.GATHER_T, DAY, paths[schemas.GATHER_T.name])
    in_dag = sink.conform(gather.feature_gather_for_day(t, DAY), schemas.GATHER_T, DAY)
    cols = [c for c in written.columns if c != "etl_time"]
    assert rows(written.select(*cols)) == rows(in_dag.select(*cols))
    assert written.count() == 24


def test_catalog_table_day_overwrite(spark):
    cols = "gds_id string, city_cd string, tot_qty bigint, search_visit_pv bigint, search_visit_uv bigint"
    a = spark.createDataFrame([("g1", "c", 1, 2, 3)], cols)
    b = spark.createDataFrame([("g2", "c", 4, 5, 6)], cols)
    sink.write_day(a, schemas.SEARCH_T, "20240101", table="fm_search")
    sink.write_day(b, schemas.SEARCH_T, "20240102", table="fm_search")
    sink.write_day(b.select(*reversed(b.columns)), schemas.SEARCH_T, "20240101", table="fm_search")
    got = rows(spark.table("fm_search").select("gds_id", "tot_qty", "statis_date"))
    assert got == [("g2", 4, "20240101"), ("g2", 4, "20240102")]


def test_write_table_replaces_whole_result(spark):
    out = tempfile.mkdtemp(prefix="fm-ctas-", dir="/tmp")
    cols = "gds_id string, statis_date string, sum bigint, num bigint, sales_volume bigint, rank int"
    sink.write_table(spark.createDataFrame([("g", "20240101", 1, 2, 3, 1)], cols), schemas.SALES_VOLUME_T, out)
    sink.write_table(spark.createDataFrame([("h", "20240102", 4, 5, 6, 1)], cols), schemas.SALES_VOLUME_T, out)
    assert rows(spark.read.parquet(out).select("gds_id", "rank")) == [("h", 1)]


def test_daily_run_over_a_range_writes_every_day(spark):
    out = tempfile.mkdtemp(prefix="fm-range-", dir="/tmp")
    t = SourceTables.from_testdata(spark, SF_SMALL)
    paths = daily.run_day(spark, t, ("20240114", "20240116"), out)
    written = spark.read.schema(schemas.GATHER_T.schema).parquet(paths[schemas.GATHER_T.name])
    days = sorted(r.statis_date for r in written.select("statis_date").distinct().collect())
    assert days == ["20240114", "20240115", "20240116"]
    one = sink.read_day(spark, schemas.GATHER_T, DAY, paths[schemas.GATHER_T.name])
    cols = [c for c in one.columns if c not in ("etl_time",)]
    expected = sink.conform(gather.feature_gather_for_day(t, DAY), schemas.GATHER_T, DAY)
    assert rows(one.select(*cols)) == rows(expected.select(*cols))


def test_rerun_with_empty_result_empties_the_day(spark):
    out = tempfile.mkdtemp(prefix="fm-empty-", dir="/tmp")
    cols = "gds_id string, city_cd string, p_clct_uv_num bigint, cart_flag_uv_num bigint"
    df = spark.createDataFrame([("g1", "c", 1, 2)], cols)
    sink.write_day(df, schemas.FAVOURITE_CART_T, "20240101", path=out)
    sink.write_day(df, schemas.FAVOURITE_CART_T, "20240102", path=out)
    sink.write_day(df.where("false"), schemas.FAVOURITE_CART_T, "20240101", path=out)
    back = spark.read.schema(schemas.FAVOURITE_CART_T.schema).parquet(out)
    assert rows(back.select("gds_id", "statis_date")) == [("g1", "20240102")]
    # a range run: days with rows are replaced, days without rows emptied, others kept
    rng = spark.createDataFrame([("g9", "c", 1, 1, "20240103")], cols + ", statis_date string")
    sink.write_day(df, schemas.FAVOURITE_CART_T, "20240104", path=out)
    sink.write_day(rng, schemas.FAVOURITE_CART_T, ("20240102", "20240103"), path=out)
    back = spark.read.schema(schemas.FAVOURITE_CART_T.schema).parquet(out)
    assert rows(back.select("gds_id", "statis_date")) == [("g1", "20240104"), ("g9", "20240103")]


def test_catalog_rerun_with_empty_result_empties_the_day(spark):
    cols = "gds_id string, city_cd string, p_clct_uv_num bigint, cart_flag_uv_num bigint"
    df = spark.createDataFrame([("g1", "c", 1, 2)], cols)
    sink.write_day(df, schemas.FAVOURITE_CART_T, "20240101", table="fm_cart")
    sink.write_day(df, schemas.FAVOURITE_CART_T, "20240102", table="fm_cart")
    sink.write_day(df.where("false"), schemas.FAVOURITE_CART_T, "20240101", table="fm_cart")
    assert rows(spark.table("fm_cart").select("gds_id", "statis_date")) == [("g1", "20240102")]


def test_daily_run_into_catalog_tables_and_again(spark):
    t = SourceTables.from_testdata(spark, SF_SMALL)
    spark.sql("CREATE DATABASE IF NOT EXISTS fm_mart")
    names = daily.run_day(spark, t, DAY, database="fm_mart")
    cols = [c for c in spark.table(names[schemas.GATHER_T.name]).columns if c != "etl_time"]
    first = rows(spark.table(names[schemas.GATHER_T.name]).select(*cols))
    daily.run_day(spark, t, DAY, database="fm_mart", d1="20240114", d7="20240108")
    again = spark.table(names[schemas.GATHER_T.name]).select(*cols)
    assert first and rows(again) == first
    expected = sink.conform(gather.feature_gather_for_day(t, DAY), schemas.GATHER_T, DAY).select(*cols)
    assert rows(again) == rows(expected)
    with pytest.raises(ValueError):
        daily.run_day(spark, t, DAY)


def test_write_table_into_the_catalog(spark):
    cols = "gds_id string, statis_date string, sum bigint, num bigint, sales_volume bigint, rank int"
    for gds in ("g", "h"):
        sink.write_table(spark.createDataFrame([(gds, "20240101", 1, 2, 3, 1)], cols), schemas.SALES_VOLUME_T,
                         table="fm_volume")
    assert rows(spark.table("fm_volume").select("gds_id", "rank")) == [("h", 1)]
