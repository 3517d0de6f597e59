"""Command line: ``python -m quillon list`` and ``python -m quillon run NAME --tables DIR [--out DIR | --show N]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quillon.plans import analyses, campaign, catalog, papers, rasters, reports  # noqa: F401


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="quillon", description="Runs registered queries over a folder of Parquet tables.")
    commands = made.add_subparsers(dest="command", required=True)
    names = commands.add_parser("list", help="names of the queries")
    names.add_argument("--with-sql", action="store_true", help="only those with a SQL twin")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("name", choices=sorted(catalog.QUERIES), metavar="NAME")
    run.add_argument("--tables", required=True, help="folder of the Parquet tables")
    run.add_argument("--out", help="folder to write the result to; it must not exist unless --overwrite")
    run.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    run.add_argument("--overwrite", action="store_true")
    run.add_argument("--show", type=int, default=20, help="rows to print if nothing is written")
    run.add_argument("--master", help="Spark master, if spark-submit doesn't set it")
    return made


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.ORACLE_SQL if args.with_sql else catalog.QUERIES)))
        return 0
    builder = SparkSession.builder.appName(f"quillon {args.name}")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    rows = catalog.QUERIES[args.name](spark, args.tables)
    if args.out:
        writer = rows.write.mode("overwrite" if args.overwrite else "errorifexists").format(args.format)
        (writer.option("header", True) if args.format == "csv" else writer).save(args.out)
    else:
        rows.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
