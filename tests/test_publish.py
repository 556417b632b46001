"""Checked publication of a day, the daily visit state in the runner, and the shared inputs of the wide table."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from featuremart import schemas, sink
from featuremart.__main__ import main
from featuremart.plans import daily, gather, sales
from featuremart.queries import DAY
from featuremart.sources import SourceTables, shift_day


@pytest.fixture(scope="module")
def t(spark):
    return SourceTables.from_testdata(spark, SF_SMALL)


def day_of(spark, root, target, day=DAY):
    return rows(sink.read_day(spark, target, day, path=daily.target_path(root, target)).drop("etl_time"))


def test_a_failing_check_leaves_every_target(spark, t, tmp_path):
    root = str(tmp_path / "mart")
    counted = daily.publish_day(spark, t, DAY, root)
    before = {tg.name: day_of(spark, root, tg) for tg in schemas.DAILY}
    assert counted == {name: len(r) for name, r in before.items()} and all(before.values())
    fewer = t.replace(order=t.order.where("gds_id > '3'"))  # would change all of sales, search, members and the wide table

    def refuse(frames):
        assert len(frames) == 6 and frames["sales_features_d"].count() < counted["sales_features_d"]
        raise sink.CheckFailed("not today")

    for options in ({"checks": [refuse]}, {"least_rows": {"sales_features_d": counted["sales_features_d"]}}):
        with pytest.raises(sink.CheckFailed):
            daily.publish_day(spark, fewer, DAY, root, **options)
        assert {tg.name: day_of(spark, root, tg) for tg in schemas.DAILY} == before
    daily.publish_day(spark, fewer, DAY, root)
    assert day_of(spark, root, schemas.SALES_T) != before["sales_features_d"]
    assert day_of(spark, root, schemas.VISITS_T) == before["visit_features_d"]


def test_check_of_keys(spark):
    schema = "gds_id string, city_cd string, tot_qty int, search_visit_pv int, search_visit_uv int, statis_date string"
    once = [("1", "a", 1, 1, 1, DAY), ("1", None, 1, 1, 1, DAY), ("1", "a", 1, 1, 1, "20240116")]
    assert sink.check_day(spark.createDataFrame(once, schema), schemas.SEARCH_T) == 3
    assert sink.check_day(spark.createDataFrame([], schema), schemas.SEARCH_T) == 0
    with pytest.raises(sink.CheckFailed, match="occurs 2 times"):
        sink.check_day(spark.createDataFrame(once + once[1:2], schema), schemas.SEARCH_T)
    with pytest.raises(sink.CheckFailed, match="at least 4"):
        sink.check_day(spark.createDataFrame(once, schema), schemas.SEARCH_T, 4)


def test_runner_with_visit_state(spark, t, tmp_path):
    plain, kept = str(tmp_path / "plain"), str(tmp_path / "kept")
    days = [shift_day(DAY, n) for n in (-1, 0)]
    for day in days:  # the second day finds the first one's state
        daily.run_day(spark, t, day, plain)
        daily.run_day(spark, t, day, kept, visit_state=True)
    daily.run_day(spark, t, days[1], kept, visit_state=True)  # and a repeated day changes nothing
    for day in days:
        for tg in (schemas.VISITS_T, schemas.GATHER_T):
            assert day_of(spark, kept, tg, day) == day_of(spark, plain, tg, day)
    assert sink.has_day(spark, schemas.VISIT_DAYS_T, DAY, path=daily.target_path(kept, schemas.VISIT_DAYS_T))
    assert not sink.has_day(spark, schemas.VISIT_DAYS_T, DAY, path=daily.target_path(plain, schemas.VISIT_DAYS_T))
    with pytest.raises(ValueError):
        daily.run_day(spark, t, DAY, kept, visit_state=True, d7=shift_day(DAY, -9))
    with pytest.raises(ValueError):
        daily.run_day(spark, t, (days[0], DAY), kept, visit_state=True)


def test_command_line_publishes(spark, capsys, tmp_path):
    out = str(tmp_path)
    assert main(["run-day", "--date", DAY, "--publish", "--visit-state", "--out", f"{out}/mart", "--testdata", SF_SMALL]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["product_features_d"] == len(
        day_of(spark, f"{out}/mart", schemas.GATHER_T))
    args = ["sales-volume", "--start", "20240101", "--end", "20240131", "--min-days", "10", "--testdata", SF_SMALL]
    assert main([*args, "--out", f"{out}/plain"]) == 0
    assert main([*args, "--out", f"{out}/stored", "--store", f"{out}/store", "--update", "20240101", "20240131"]) == 0
    assert rows(spark.read.parquet(f"{out}/stored")) == rows(spark.read.parquet(f"{out}/plain"))


def test_one_pass_promotion_equals_the_stacked_form(spark, t):
    for day in (DAY, "20240103"):
        base = sales.with_promotion(sales.sales_base(t, day), t, day)
        assert rows(sales.sales_features(t, day, base=base)) == rows(sales.sales_features_stacked(t, day))
    lo, hi = "20240110", "20240120"
    base = sales.with_promotion(sales.sales_base(t, (lo, hi)), t, (lo, hi))
    assert rows(sales.sales_features(t, (lo, hi), base=base)) == rows(sales.sales_features(t, (lo, hi)))


@pytest.mark.parametrize("days", [DAY, ("20240110", "20240120")])
def test_wide_table_scans_shared_inputs(t, days):
    wide = gather.feature_gather_for_day(t, days)
    wide.collect()
    text = wide._jdf.queryExecution().executedPlan().toString()
    final = text[:text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    assert final.count("FileScan") <= 12
    assert rows(wide) == rows(gather.feature_gather_joined(*_parts(t, days)))


def _parts(t, days):
    from featuremart.plans import clct_cart, members, search, visits
    return (sales.sales_features(t, days), visits.gds_visit(t, days), clct_cart.gds_clct_cart(t, days),
            search.gds_search(t, days), members.gds_member(t, days))


def test_wide_table_hashes_its_groups_and_stages_only_sold_products(spark, t, monkeypatch):
    staged = {}
    monkeypatch.setattr(gather, "stage", lambda df, name, keep=gather.stage: staged.setdefault(name, keep(df, name)))
    wide = gather.feature_gather_for_day(t, DAY)
    assert "SortAggregate" not in wide._jdf.queryExecution().executedPlan().toString()
    lines = staged["order-lines"].where(F.col("chnl_cd") == gather.GATHERED_CHANNEL).select("gds_id", "city_cd")
    for name, table, lo in (("web-views", t.web_visit, DAY), ("app-views", t.app_visit, DAY), ("visits", t.cust_visit, "20240108")):
        whole = t.selected(table.where(F.col("statis_date").between(lo, DAY)))
        of_sold = whole.join(lines, ["gds_id", "city_cd"], "left_semi")
        kept = staged[name].join(lines, ["gds_id", "city_cd"], "left_semi")
        assert kept.count() == of_sold.count() and staged[name].count() <= whole.count() / 2


def test_daily_run_reads_the_page_views_once(spark, t, tmp_path, monkeypatch):
    read = []
    monkeypatch.setattr(gather.clct_cart, "channel_views", lambda *a, keep=gather.clct_cart.channel_views: read.append(1) or keep(*a))
    monkeypatch.setattr(daily.search, "channel_views", gather.clct_cart.channel_views)
    daily.run_day(spark, t, DAY, str(tmp_path / "out"))
    assert len(read) == 1
