"""Command line: build all tables from CSV files, or run SQL on stored tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from storelens.operators.quality import missing_tables
from storelens.plans.build import build_all
from storelens.plans.sqlpack import run_single
from storelens.sources.tables import load_all, register, table_inventory


def main() -> None:
    parser = argparse.ArgumentParser(prog="storelens", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="build every table")
    build.add_argument("raw", help="folder with the CSV files")
    build.add_argument("out", help="folder for the tables")
    build.add_argument("--file", action="append", default=[], metavar="TABLE=NAME",
                       help="file of a raw table, where it is not TABLE.csv")
    sql = commands.add_parser("sql", help="run one query on the stored tables")
    sql.add_argument("out")
    sql.add_argument("text")
    sql.add_argument("--rows", type=int, default=100, help="rows to print")
    args = parser.parse_args()

    spark = SparkSession.builder.appName("storelens").getOrCreate()
    if args.command == "build":
        build_all(spark, args.raw, args.out, dict(f.split("=", 1) for f in args.file))
        stored = load_all(spark, args.out)
        table_inventory(stored).show(100, truncate=False)
        for name in missing_tables(stored):
            print(f"no table {name}")
    else:
        register(load_all(spark, args.out))
        run_single(spark, args.text).show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
