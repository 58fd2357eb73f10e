"""Command line: ``python -m marketlens run|profile|query``, also through ``spark-submit``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from marketlens import workflow
from marketlens.plans.analyses import ANALYSES
from marketlens.plans.marts import MARTS
from marketlens.plans.profiles import PROFILES, TABLE_PROFILES
from marketlens.schema import RAW_TABLES
from marketlens.session import build_session
from marketlens.sources import files, releases


def parse_args(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="marketlens")
    parser.add_argument("--master", help="Spark master; leave out under spark-submit")
    commands = parser.add_subparsers(dest="command", required=True)

    run = commands.add_parser("run", help="clean, validate and publish delivered files")
    run.add_argument("raw_folder")
    run.add_argument("out_folder")
    run.add_argument("--database")
    run.add_argument("--buckets", type=int)
    run.add_argument("--append", action="store_true", help="add to the published tables; the same delivery adds nothing")
    run.add_argument("--batch", help="id of the appended delivery instead of a digest of its contents")

    profile = commands.add_parser("profile", help="profile delivered files")
    profile.add_argument("raw_folder")
    profile.add_argument("report", nargs="*", choices=[[], *PROFILES], default=[])

    query = commands.add_parser("query", help="show an analysis or mart over published tables")
    query.add_argument("folder", help="folder of the published tables")
    query.add_argument("name", choices=[*ANALYSES, *MARTS])
    for command in (profile, query):
        command.add_argument("--rows", type=int, default=100, help="rows that are printed of each result")
        command.add_argument("--out", help="folder for whole results as Parquet; nothing is printed then")
    for command in (run, profile):
        command.add_argument(
            "--file",
            action="append",
            default=[],
            metavar="TABLE=NAME",
            help="file name of a delivered table; every other CSV of the folder is profiled under its own name",
        )
        command.add_argument(
            "--single-line",
            action="append",
            default=[],
            metavar="TABLE",
            help="declare that a table has a record per line: its files are divided among tasks, other records stop the run",
        )
    return parser.parse_args(argv)


def deliver(rows: DataFrame, name: str, args: argparse.Namespace) -> None:
    """Write a whole result, or print its first rows."""
    if args.out:
        rows.write.mode("overwrite").parquet(f"{args.out}/{name}")
    else:
        rows.show(args.rows, truncate=False)


def main(argv: list[str] | None = None) -> None:
    args = parse_args(argv)
    spark = build_session(args.master)
    names = dict(pair.split("=", 1) for pair in getattr(args, "file", []))
    if args.command == "run":
        written = workflow.run(
            spark,
            args.raw_folder,
            args.out_folder,
            file_names=names,
            database=args.database,
            buckets=args.buckets,
            mode="append" if args.append else "overwrite",
            batch=args.batch,
            single_line=args.single_line,
        )
        files.load_report(spark, written).show(truncate=False)
    elif args.command == "profile":
        # every CSV of the folder is a table, those of the model and others; --file gives other names
        found = releases.csv_tables(spark, args.raw_folder)
        names = {t: n for t, n in found.items() if n not in names.values()} | names
        raw = files.read_raw(spark, args.raw_folder, {t: n for t, n in names.items() if t in RAW_TABLES}, args.single_line)
        others = {
            table: files.read_csv_table(spark, f"{args.raw_folder}/{name}", table in args.single_line)
            for table, name in names.items()
            if table not in RAW_TABLES
        }
        for report in args.report or PROFILES:
            print(report)
            if report in TABLE_PROFILES:
                rows = TABLE_PROFILES[report](raw.as_dict() | others)
            else:
                rows = PROFILES[report](raw)
            deliver(rows, report, args)
    else:
        tables = files.read_processed(spark, args.folder)
        deliver((ANALYSES | MARTS)[args.name](tables), args.name, args)


if __name__ == "__main__":
    main()
