"""Command line: load a CSV into tables, run analyses to reports, check data quality.

    python -m shelfsight load inventory.csv /shared/star
    python -m shelfsight run /shared/star /shared/reports q2_low_inventory_alerts
    python -m shelfsight check /shared/star
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from shelfsight.model import Tables
from shelfsight.operators.loading import table_row_counts
from shelfsight.operators.quality import dropped_rows, violations
from shelfsight.sources.csv_files import load_staging
from shelfsight.sources.parquet_tables import current_version, open_star_schema, persist_star_schema
from shelfsight.suite import CATALOGUE, PRODUCTION, run_suite


def _arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="shelfsight", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="CSV to staging table and star schema")
    load.add_argument("csv")
    load.add_argument("star")
    load.add_argument("--strict", action="store_true", help="fail if a table constraint is broken")
    run = commands.add_parser("run", help="analyses to CSV reports; the production suite if unnamed")
    run.add_argument("star")
    run.add_argument("out")
    run.add_argument("names", nargs="*", metavar="name")
    run.add_argument("--again", action="store_true", help="also reports already finished for the present load")
    check = commands.add_parser("check", help="count violations of the table constraints")
    check.add_argument("star")
    return parser.parse_args()


def _end_on_violations(tables: Tables) -> None:
    found = violations(tables)
    for check, count in found:
        print(f"{check:50} {count}")
    if found:
        raise SystemExit(1)


def main() -> None:
    args = _arguments()
    spark = SparkSession.builder.appName("shelfsight").getOrCreate()
    if args.command == "load":
        tables = persist_star_schema(load_staging(spark, args.csv), args.star)
        for line in table_row_counts(tables).collect():
            print(f"{line.table_name:24} {line.rows}")
        print(f"{'dropped, no region':24} {dropped_rows(tables).first().violations}")
        if args.strict:
            _end_on_violations(tables)
    elif args.command == "run":
        unknown = [name for name in args.names if name not in CATALOGUE]
        if unknown:
            raise SystemExit(f"unknown: {', '.join(unknown)}")
        tables = open_star_schema(spark, args.star)
        load = None if args.again else current_version(spark, args.star)
        for outcome in run_suite(tables, args.out, args.names or PRODUCTION, resume=load):
            print(f"{outcome.name:34} {outcome.error or outcome.rows}")
    else:
        _end_on_violations(open_star_schema(spark, args.star))


if __name__ == "__main__":
    main()
