"""Command line: a query of the catalogue over a folder of tables, or a selection from a folder of pictures."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from lumenrank.plans import folder
from lumenrank.plans.catalogue import QUERIES
from lumenrank.sources import config, galleries

FOLDERS = ("select", "dedup", "gallery")


class _Parser(argparse.ArgumentParser):
    """Tells the whole help on an error."""

    def error(self, message: str):
        self.print_help(sys.stderr)
        self.exit(2, f"\nerror: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="lumenrank", description=__doc__)
    p.add_argument("query", choices=[*sorted(QUERIES), *FOLDERS], metavar="QUERY", help="a name of the catalogue; or select, dedup or gallery")
    p.add_argument("tables", help="the folder that holds <table>.parquet; or the folder of pictures, or of reports")
    p.add_argument("--out", help="write the result there (a query's as Parquet) instead of showing it")
    p.add_argument("--rows", type=int, default=20, help="rows to show")
    p.add_argument("--work", help="where resized pictures are kept between runs (default: <out>/work)")
    p.add_argument("--top", type=int, default=10, help="pictures to select")
    p.add_argument("--share", type=float, default=0.5, help="share of pictures that the model scores")
    p.add_argument("--all", action="store_true", dest="all_scored", help="let the model score all pictures")
    p.add_argument("--crop-first", action="store_true", help="show the model the crop")
    p.add_argument("--model", help="the model's name")
    p.add_argument("--context", help="what the model is told about the account")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.query in FOLDERS and not os.path.isdir(args.tables):
        print(f"no such folder: {args.tables}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("lumenrank").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = args.out or f"{args.tables.rstrip('/')}/selected"
    if args.query == "gallery":
        print(f"{galleries.rebuild(spark, args.tables)} galleries")
        return 0
    if args.query in FOLDERS:
        places = [config.process_env()]
        for path in (".env", os.path.join(args.tables, ".env")):
            if os.path.isfile(path):
                with open(path, encoding="utf-8") as f:
                    places.append(config.parse_env(f.read()))
        o = folder.Options(top=args.top, share=args.share, all_scored=args.all_scored, crop_first=args.crop_first, account=args.context or config.account_context(places), model=args.model or folder.Options.model)
        run = folder.select if args.query == "select" else folder.dedup_only
        run(spark, args.tables, out, args.work or f"{out}/work", o)
        return 0
    df = QUERIES[args.query](spark, args.tables)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.rows, truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main())
