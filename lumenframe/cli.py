"""Command line: ``analyze FOLDER``, ``ingest --source --event`` and ``resume``."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from . import report
from .config import ConfigurationError, FileTypes, IngestConfig, PeekConfig, RawBackupConfig, check_source, load, unique_backup_directory


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenframe")
    top.add_argument("-v", "--verbose", action="count", default=0)
    top.add_argument("-q", "--quiet", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze")
    a.add_argument("folder")
    a.add_argument("--config")
    for flag in ("--json", "--peek", "--exif-only", "--summary"):
        a.add_argument(flag, action="store_true")
    a.add_argument("--samples", type=int, default=5, help="files of each kind that --peek shows")
    a.add_argument("--describe", metavar="MODULE:FUNCTION", help="with --peek: a function from a file's path to a note on it")
    a.add_argument("--exiftool", action="store_true", help="read tags with the external tool where it is installed")
    a.add_argument("--workers", type=int, default=4)
    a.add_argument("--catalog", help="a catalog whose caches spare listing unchanged directories and opening known files")
    a.add_argument("--detailed", action=argparse.BooleanOptionalAction, default=True)
    a.add_argument("--basic", dest="detailed", action="store_false")
    i = commands.add_parser("ingest")
    i.add_argument("--config")
    i.add_argument("--source", required=True)
    i.add_argument("--event", required=True)
    i.add_argument("--dry-run", action="store_true")
    i.add_argument("--copy", dest="copy", action="store_true", default=True)
    i.add_argument("--move", dest="copy", action="store_false")
    i.add_argument("--raw-only", action="store_true")
    i.add_argument("--organized-only", action="store_true")
    i.add_argument("--archive", help="archive root, where no settings are given")
    i.add_argument("--catalog", default=".lumenframe-catalog")
    i.add_argument("--exiftool", action="store_true", help="read tags with the external tool where it is installed")
    r = commands.add_parser("resume", help="finish ingests that were cut short")
    r.add_argument("--catalog", default=".lumenframe-catalog")
    r.add_argument("--workers", type=int, default=4)
    return top


def _spark(workers: int = 4):
    from pyspark.sql import SparkSession

    return SparkSession.builder.master(f"local[{workers}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(workers)).getOrCreate()


def _fail(text: str) -> int:
    print(f"Error: {text}", file=sys.stderr)
    return 1


def analyze(args: argparse.Namespace) -> int:
    from .pipeline import analyse, describer, peek, scan_directory

    if args.peek and args.exif_only:
        return _fail("--peek and --exif-only exclude each other")
    good, why = check_source(args.folder)
    if not good:
        return _fail(why)
    types, settings = FileTypes(), PeekConfig()
    if args.config or args.peek:
        try:
            found = load(args.config)
            types, settings = found.file_types, found.peek
        except ConfigurationError as e:
            if not args.quiet:
                print(f"Settings ignored: {e}", file=sys.stderr)
    spark = _spark(args.workers)
    row = analyse(spark, args.folder, types, args.detailed, args.exiftool, args.catalog).head()
    print(report.as_json(row) if args.json else report.one_line(row) if args.summary else report.human_readable(row, args.detailed) if args.verbose else report.plain(row))
    if args.peek and settings.enabled:
        files = scan_directory(spark, args.folder, types).where("error is null")
        shown = peek(files, replace(settings, sample_count=args.samples), describer(args.describe) if args.describe else None)
        print(report.peek_text(shown.orderBy("file_type", "seq").collect()))
    return 0 if row["total_files"] else _fail("no file here is of a supported type")


def ingest(args: argparse.Namespace) -> int:
    from .operators import plan
    from .pipeline import ingest as run

    if args.raw_only and args.organized_only:
        return _fail("--raw-only and --organized-only exclude each other")
    try:
        config = IngestConfig(args.archive, raw_backup=RawBackupConfig(enabled=True, backup_root=f"{args.archive}/backup")) if args.archive and not args.config else load(args.config)
    except ConfigurationError as e:
        return _fail(str(e))
    backup = str(unique_backup_directory(config.raw_backup.backup_root, config.raw_backup.timestamp_format))
    ops, outcome = run(_spark(config.performance.parallel_workers), args.source, args.event, config, args.catalog, backup, args.dry_run, args.copy, args.raw_only, args.organized_only, args.exiftool)
    if args.dry_run:
        devices = [(r["device_code"], r["files"]) for r in plan.per_device(ops).orderBy("device_code").collect()]
        print(report.plan_text(plan.breakdown(ops).head(), devices, ops.orderBy("seq").limit(5).collect(), True))
    else:
        print(report.result_text(outcome.head()))
    return 0


def resume(args: argparse.Namespace) -> int:
    from .pipeline import resume as run

    for event, outcome in run(_spark(args.workers), args.catalog):
        print(f"Event: {event}")
        print(report.result_text(outcome.head()))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return {"analyze": analyze, "ingest": ingest, "resume": resume}[args.command](args)
