"""Command line: ``python -m quillmere.cli --export-path DIR [--export-path DIR] (--validate-only | --store-path DIR)``.

Exit codes: 0 completed, 2 completed with errors, 1 failed, invalid use or report not written.
"""

from __future__ import annotations

import argparse
import os
import sys

from quillmere.plans.inventory import import_collection, validate_collection
from quillmere.session import build_session, cleared
from quillmere.sources.discovery import DiscoveryError
from quillmere.sources.store import StoreLocked, replace_json

EXIT = {"completed": 0, "completed_with_errors": 2, "failed": 1}


def summary(report: dict) -> str:
    """A few lines on a report, without content of records."""
    if report["mode"] == "validate":
        s = report["summary"]
        lines = [f"Validation: {report['status']}"] + [f"  {k}: {s[k]}" for k in ("files", "examined", "parsed", "partial", "unsupported", "errors") if k in s]
        return "\n".join(lines + [f"  {e['code']}" for e in report["errors"] if not s])
    albums = [f for f in report["files"] if f["kind"] == "album_metadata"]
    lines = [f"Import: {report['status']} in {report['duration_ms'] / 1000:.2f} s, peak {report['peak_rss_bytes'] / 2**20:.2f} MB"]
    lines += [f"  {k}: {report[k]}" for k in ("records_examined", "records_matched", "posts_added", "posts_updated", "records_ambiguous", "records_skipped", "error_count", "canonical_posts", "integrity")]
    lines += [f"  {k}: {v}" for k, v in sorted(report["match_rule_counts"].items())]
    if albums:
        lines.append(f"  albums: {sum(f['records'] for f in albums)} records in {len(albums)} files, {sum(f['errors'] for f in albums)} errors")
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmere", exit_on_error=False)
    parser.add_argument("--export-path", action="append", required=True)
    parser.add_argument("--store-path")
    parser.add_argument("--report-path")
    parser.add_argument("--validate-only", action="store_true")
    try:
        args = parser.parse_args(argv)
        if args.validate_only == bool(args.store_path):
            raise argparse.ArgumentError(None, "give either --validate-only or --store-path")
    except (argparse.ArgumentError, SystemExit) as e:
        print(e, file=sys.stderr)
        return 1
    spark = build_session("quillmere-cli")
    if args.store_path and not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        # The store lies where all executors reach it, and so do the tables of the run.
        spark.sparkContext.setCheckpointDir(os.path.join(os.path.abspath(args.store_path), "_work"))
    try:
        with cleared(spark):
            report = validate_collection(spark, args.export_path) if args.validate_only else import_collection(spark, args.export_path, args.store_path)
    except (DiscoveryError, StoreLocked, ValueError) as e:
        print(f"{getattr(e, 'code', type(e).__name__)}: {e}", file=sys.stderr)
        return 1
    path = args.report_path or (None if args.validate_only else os.path.join(args.store_path, "last-import-report.json"))
    print(summary(report))
    if path:
        try:
            replace_json(path, report)
        except OSError as e:
            print(f"the report could not be written: {e}", file=sys.stderr)
            return 1
    return EXIT[report["status"]]


if __name__ == "__main__":
    sys.exit(main())
