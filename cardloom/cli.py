"""Command line: convert, dedupe, normalize, and vcf-to-csv.

    python -m cardloom.cli [--out FILE] [--verbose] COMMAND [FILE] [options]

FILE is a path that Spark can read; standard input without one or with -.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from cardloom.config import CONVERT, DEDUPE, NORMALIZE, DedupeConfig, NameConfig
from cardloom.operators.normalize import normalize_records
from cardloom.plans.pipelines import convert, deduplicate, normalize_and_convert
from cardloom.settings import read_env
from cardloom.storage import spool
from cardloom.sources import sinks
from cardloom.sources.csv import read_contacts_csv
from cardloom.sources.vcf import read_vcf


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cardloom", description="Clean, resolve and convert contact records.")
    p.add_argument("--out", "-o", help="output file (default: standard output)")
    p.add_argument("--verbose", "-v", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="CSV to vCard 4.0")
    c.add_argument("file", nargs="?")
    c.add_argument("--dedupe", "-d", action="store_true")
    d = sub.add_parser("dedupe", help="find and merge duplicates in a CSV file")
    d.add_argument("file", nargs="?")
    d.add_argument("--json", "-j", action="store_true")
    d.add_argument("--dry-run", "-n", action="store_true")
    own = DedupeConfig()
    for name in ("threshold", "email_weight", "phone_weight", "name_weight", "org_weight", "min_name_similarity"):
        d.add_argument("--" + name.replace("_", "-"), type=float, default=getattr(own, name))
    n = sub.add_parser("normalize", help="normalize the contacts of a CSV file")
    n.add_argument("file", nargs="?")
    n.add_argument("--json", "-j", action="store_true")
    n.add_argument("--vcf", action="store_true", help="vCard output of fully normalized contacts")
    n.add_argument("--dedupe", "-d", action="store_true", help="with --vcf: merge duplicates")
    n.add_argument("--env", help="with --vcf: settings of a name service")
    v = sub.add_parser("vcf-to-csv", help="vCard to CSV")
    v.add_argument("file", nargs="?")
    v.add_argument("--separator", default=sinks.SEPARATOR)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    path = a.file
    if not path or path == "-":  # executors read it, so it goes to the shared folder
        path = spool(spark, iter(lambda: sys.stdin.buffer.read(1 << 20), b""))
    out = sinks.open_out(a.out, sys.stdout)
    try:
        run(a, spark, path, out)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        if out is not sys.stdout:
            out.close()
    return 0


def run(a: argparse.Namespace, spark: SparkSession, path: str, out) -> None:
    err = sys.stderr
    if a.command == "vcf-to-csv":
        sinks.stream_csv(read_vcf(spark, path).contacts, out, separator=a.separator)
        return
    parsed = read_contacts_csv(spark, path, {"convert": CONVERT, "dedupe": DEDUPE, "normalize": NORMALIZE}[a.command])
    if a.command == "convert":
        done = convert(parsed, a.dedupe)
        sinks.stream_vcf(done.contacts, out)
        if a.verbose:
            s = done.summary.first()
            print(f"\nConversion Summary:\n  Input contacts:      {s['input_contacts']}\n  Output vCards:       {s['output_vcards']}\n  Duplicates removed:  {s['duplicates_removed']}\n  Parse errors:        {s['parse_errors']}", file=err)
            for e in done.errors.orderBy("row").toLocalIterator():
                print(f"    row {e['row']}: {e['message']}", file=err)
    elif a.command == "normalize" and a.vcf:
        llm = read_env(a.env).client() if a.env else None
        sinks.stream_vcf(normalize_and_convert(parsed, NameConfig(use_llm=llm is not None, llm=llm), dedupe=a.dedupe).contacts, out)
    elif a.command == "normalize":
        records = normalize_records(parsed.contacts)
        if a.json:
            sinks.stream_json(records, out)
        else:
            sinks.stream_csv(records, out, org="org")
    else:
        if parsed.contacts.isEmpty():
            print("No contacts found.", file=err)
            return
        cfg = DedupeConfig(a.email_weight, a.phone_weight, a.name_weight, a.org_weight, a.threshold, a.min_name_similarity)
        r = deduplicate(parsed.contacts, cfg)
        if a.dry_run:
            sinks.stream_dry_run(r.report, sinks.dry_run_lines(r.contacts, r.clusters), err)
        elif a.json:
            sinks.stream_dedupe_json(r.report, sinks.cluster_json(r.contacts, r.clusters), r.merged, out)
        else:
            sinks.stream_csv(r.resolved, out)


if __name__ == "__main__":
    sys.exit(main())
