"""Command-line runner.

  python -m featuremart run-day --date 20240115 [--to 20240131] --out /shared/mart (--testdata DIR | --catalog names.json)
  python -m featuremart bucket-members --table mart.members --buckets 512 (--testdata DIR | --catalog names.json)
  python -m featuremart sales-volume --start 20160101 --end 20171231 --min-days 600 --rank-limit 10000 \\
      --out /shared/mart/sales_volume_stats (--testdata DIR | --catalog names.json)

``--catalog`` (or ``--paths`` for parquet folders) names a JSON object mapping source roles (order, goods, deal, cust_visit, web_visit,
app_visit, web_click, app_click, member) to catalog table names. The day is a function argument,
never text substituted into SQL.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _tables(spark: SparkSession, args):
    from featuremart.sources import SourceTables
    if args.testdata:
        return SourceTables.from_testdata(spark, args.testdata)
    if args.paths:
        with open(args.paths) as fh:
            return SourceTables.from_paths(spark, json.load(fh))
    with open(args.catalog) as fh:
        return SourceTables.from_catalog(spark, json.load(fh))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="featuremart")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("run-day", "sales-volume", "bucket-members"):
        sp = sub.add_parser(name)
        src = sp.add_mutually_exclusive_group(required=True)
        src.add_argument("--testdata", help="test-data folder (sf*/) to bind the sources to")
        src.add_argument("--catalog", help="JSON file: source role -> catalog table")
        src.add_argument("--paths", help="JSON file: source role -> parquet folder (partitioned by statis_date)")
        if name != "bucket-members":
            out = sp.add_mutually_exclusive_group(required=True)
            out.add_argument("--out", help="output root (run-day) or table folder (sales-volume)")
            out.add_argument("--database", help="catalog database of the target tables")
        sp.add_argument("--master", default=None, help="only for local runs, e.g. local[8]")
    sub.choices["run-day"].add_argument("--date", required=True, help="yyyyMMdd (first day with --to)")
    sub.choices["run-day"].add_argument("--to", default=None, help="last day of a backfill range, yyyyMMdd")
    sub.choices["run-day"].add_argument("--d1", default=None, help="last earlier day of returning visitors, yyyyMMdd")
    sub.choices["run-day"].add_argument("--d7", default=None, help="first earlier day of returning visitors, yyyyMMdd")
    sub.choices["run-day"].add_argument("--approx-distinct", action="store_true",
                                        help="HyperLogLog distinct counts instead of exact ones")
    sub.choices["run-day"].add_argument("--visit-state", action="store_true",
                                        help="keep the visitors' days as a state table and scan one day of visits")
    sub.choices["run-day"].add_argument("--publish", action="store_true",
                                        help="run into a staging folder and replace the targets only if all checks pass")
    sub.choices["run-day"].add_argument("--bucketed-members", default=None, metavar="TABLE",
                                        help="catalog table that bucket-members wrote: it is joined without a shuffle")
    bm = sub.choices["bucket-members"]
    bm.add_argument("--table", required=True, help="catalog table to create or replace")
    bm.add_argument("--buckets", type=int, required=True, help="number of buckets of member_id")
    sv = sub.choices["sales-volume"]
    sv.add_argument("--store", default=None, help="folder of the paid-quantity store; --update first replaces its days")
    sv.add_argument("--update", default=None, nargs=2, metavar=("LO", "HI"), help="days of the store to replace")
    sv.add_argument("--start", default="20160101")
    sv.add_argument("--end", default="20171231")
    sv.add_argument("--min-days", type=int, default=600)
    sv.add_argument("--rank-limit", type=int, default=10_000)
    sv.add_argument("--dense", action="store_true", help="rank products with dense_rank")
    args = p.parse_args(argv)

    if args.master:
        from featuremart.session import build_session
        spark = build_session(master=args.master)
    else:
        spark = SparkSession.builder.getOrCreate()
    t = _tables(spark, args)
    if args.cmd == "bucket-members":
        from featuremart import sink
        sink.write_bucketed(t.member, args.table, "member_id", args.buckets)
        print(json.dumps({"member": args.table}))
    elif args.cmd == "run-day":
        if args.bucketed_members:
            t = t.with_bucketed(member=args.bucketed_members)
        from featuremart.plans.daily import publish_day, run_day
        run = publish_day if args.publish else run_day
        done = run(spark, t, (args.date, args.to) if args.to else args.date, args.out, approx_distinct=args.approx_distinct,
                   database=args.database, d1=args.d1, d7=args.d7, visit_state=args.visit_state)
        print(json.dumps(done))
    else:
        from featuremart import schemas, sink
        from featuremart.plans.sales_volume import read_store, sales_volume_rank, update_store
        store = None
        if args.store:
            if args.update:
                update_store(t.order, tuple(args.update), path=args.store)
            store = read_store(spark, args.start, args.end, path=args.store)
        df = sales_volume_rank(t.order, args.start, args.end, args.min_days, args.rank_limit, dense=args.dense, store=store)
        name = schemas.SALES_VOLUME_T.name
        table = f"{args.database}.{name}" if args.database else None
        sink.write_table(df, schemas.SALES_VOLUME_T, args.out, table)
        print(json.dumps({name: table or args.out}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
