"""The command-line runner, in process (it reuses the test session)."""

import json
import tempfile

from conftest import SF_SMALL
from featuremart import schemas
from featuremart.__main__ import main


def test_run_day_range_and_sales_volume(spark, capsys):
    out = tempfile.mkdtemp(prefix="fm-cli-", dir="/tmp")
    assert main(["run-day", "--date", "20240114", "--to", "20240115", "--approx-distinct", "--out", f"{out}/mart",
                 "--testdata", SF_SMALL]) == 0
    paths = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    wide = spark.read.schema(schemas.GATHER_T.schema).parquet(paths[schemas.GATHER_T.name])
    assert sorted(r[0] for r in wide.select("statis_date").distinct().collect()) == ["20240114", "20240115"]
    assert main(["sales-volume", "--start", "20240101", "--end", "20240131", "--min-days", "10", "--rank-limit", "20",
                 "--out", f"{out}/volume", "--testdata", SF_SMALL]) == 0
    assert main(["bucket-members", "--table", "cli_members", "--buckets", "4", "--testdata", SF_SMALL]) == 0
    assert main(["run-day", "--date", "20240115", "--bucketed-members", "cli_members", "--out", f"{out}/again",
                 "--testdata", SF_SMALL]) == 0
    name = schemas.MEMBERS_T.name
    day = [spark.read.schema(schemas.MEMBERS_T.schema).parquet(f"{out}/{x}/{name}").where("statis_date = '20240115'")
           .drop("etl_time") for x in ("mart", "again")]
    assert day[0].count() > 0 and day[0].exceptAll(day[1]).isEmpty() and day[1].exceptAll(day[0]).isEmpty()
    vol = spark.read.parquet(f"{out}/volume")
    assert vol.count() > 0 and vol.agg({"rank": "max"}).collect()[0][0] < 20
