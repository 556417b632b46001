"""Plan properties that matter at scale, checked on the physical plans Spark produces."""

import contextlib
import io
import tempfile

import pytest

from conftest import SF_SMALL
from featuremart.plans import clct_cart, members, sales, search, visits
from featuremart.queries import DAY
from featuremart.sources import SourceTables, testdata


def plan(df, mode: str = "simple") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def partitioned(spark):
    """The daily sources written as tables partitioned by statis_date, as in production."""
    root = tempfile.mkdtemp(prefix="fm-part-", dir="/tmp")
    frames = {}
    for name in ["order", "deal", "cust_visit", "web_visit", "app_visit", "web_click", "app_click"]:
        path = f"{root}/{name}"
        fx = testdata.BINDING[name](spark, SF_SMALL)
        fx.write.partitionBy("statis_date").parquet(path)
        # explicit schema: the partition column stays a string (no type inference of the day key)
        frames[name] = spark.read.schema(fx.schema).parquet(path)
    frames["goods"] = testdata.fx_goods(spark, SF_SMALL)
    frames["member"] = testdata.fx_member(spark, SF_SMALL)
    return SourceTables(**frames)


@pytest.mark.parametrize("job", [sales.sales_features, visits.visit_measures, clct_cart.gds_clct_cart,
                                 search.gds_search, members.gds_member])
def test_day_filter_becomes_partition_filter(spark, partitioned, job):
    text = plan(job(partitioned, DAY))
    scans = [ln for ln in text.splitlines() if "FileScan parquet" in ln and "statis_date" in ln]
    assert scans, text
    for ln in scans:
        assert "PartitionFilters: [" in ln and "20240115" in ln.split("PartitionFilters: [")[1], ln


def test_range_scan_prunes_partitions(spark, partitioned):
    text = plan(visits.returning_visitors(partitioned, DAY), "formatted")
    part = next(ln for ln in text.splitlines() if ln.startswith("PartitionFilters:"))
    assert "(statis_date#" in part and ">= 20240108" in part and "<= 20240115" in part, part


def test_no_python_evaluation_in_any_registered_query(spark):
    from __spark_entry__ import queries
    for name, fn in queries().items():
        text = plan(fn(spark, SF_SMALL))
        for op in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
            assert op not in text, (name, op)


def test_topn_limits_rows_before_the_shuffle(spark):
    from __spark_entry__ import queries
    text = plan(queries()["topn_rows"](spark, SF_SMALL))
    before_exchange = text.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before_exchange and "Partial" in before_exchange


def test_rank_never_windows_over_all_rows(spark):
    from __spark_entry__ import queries
    text = plan(queries()["sales_volume_rank"](spark, SF_SMALL))
    # the only window without a partition key runs over the bounded top-k of distinct order tuples
    for block in text.split("Window [")[1:]:
        if "windowspecdefinition(num" in block.split("\n")[0] or "windowspecdefinition(sales_volume" in \
                block.split("\n")[0]:
            assert "TakeOrderedAndProject(limit=99" in block, block[:400]


def test_scans_read_only_used_columns(spark):
    from __spark_entry__ import queries
    text = plan(queries()["letters_total"](spark, SF_SMALL))
    assert "ReadSchema: struct<text:string,lang:string>" in text or "ReadSchema: struct<lang:string,text:string>" \
        in text


def test_inferred_numeric_day_key_still_prunes_and_matches(spark, partitioned):
    # the same folders read without a schema: statis_date is inferred as a number
    import os
    from conftest import rows
    root = os.path.dirname(partitioned.order.inputFiles()[0].split("/statis_date=")[0].replace("file:", ""))
    paths = {name: f"{root}/{name}" for name in
             ["order", "deal", "cust_visit", "web_visit", "app_visit", "web_click", "app_click"]}
    inferred = SourceTables.from_paths(spark, paths).replace(goods=partitioned.goods, member=partitioned.member)
    assert dict(inferred.order.dtypes)["statis_date"] != "string"
    from featuremart.plans import gather
    text = plan(sales.sales_features(inferred, DAY), "formatted")
    assert any(ln.startswith("PartitionFilters:") and "20240115" in ln for ln in text.splitlines())
    assert rows(gather.feature_gather_for_day(inferred, DAY)) == rows(gather.feature_gather_for_day(partitioned, DAY))


def test_cart_views_are_not_sorted(spark, partitioned):
    days = ("20240110", "20240112")
    text = plan(clct_cart.gds_clct_cart(partitioned, days))
    assert text.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in text
    views = spark.createDataFrame([(d, "p", v, "c", g, "-") for d in days for v in ("a", "b", None) for g in ("1", "2")]
                                  + [(days[0], "q", "a", "c", "1", "-"), (days[0], "q", "z", "c", "3", "-")],
                                  "statis_date string, pv_id string, visitor_id string, city_cd string, gds_id string, busi_tp_id string")
    clicks = spark.createDataFrame([(days[0], "p", "shoucang01", "gmq"), (days[0], "q", "x", "y"), (days[1], "p", "x", "y")],
                                   "statis_date string, pv_id string, prmtr_id_1 string, prmtr_id_2 string")
    goods = spark.createDataFrame([("1",), ("2",), ("3",)], "gds_cd string")
    t = partitioned.replace(web_visit=views, app_visit=views.limit(0), web_click=clicks, goods=goods)
    got = sorted(tuple(r) for r in clct_cart.gds_clct_cart(t, days).collect())
    assert got == [(days[0], "1", "c", 2, 0), (days[0], "2", "c", 2, 0), (days[0], "3", "c", 0, 0),
                   (days[1], "1", "c", 0, 0), (days[1], "2", "c", 0, 0)]
