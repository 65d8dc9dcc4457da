"""Command line: ``python -m legalspark.plans.cli parse|coverage|batch|download|convert-links|schemas ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import check_schemas, write_schemas
from ..sources.documents import METHODS, convert_links, fetched, html_files, links_json, payload_files, relative_to, sliced, write_json, write_results
from .batch import audit, audit_payloads, report, run_batch
from .parse import parse_documents


def build() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="legalspark")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("parse", help="HTML files to JSON lines (doc_id, payload)")
    a.add_argument("input")
    a.add_argument("--out", required=True, help="folder for the payloads")
    a.add_argument("--validation", help="folder for the validation report; by default <out>-validation")
    a.add_argument("--no-validation", action="store_true")
    a.add_argument("--coverage", action="store_true", help="audit after parsing; ends with 1 if a document does not pass")
    a.add_argument("--oracle", choices=("naive", "mirror"), default="naive")
    a.add_argument("--celex", help="CELEX number for the summary's look-up")
    a.add_argument("--summaries", help="Parquet table of landed summary pages; without it, or with --no-summary, summaries are disabled")
    a.add_argument("--no-summary", action="store_true")
    a.add_argument("--summary-lang", help="two letters; by default the language of the HTML")
    a = sub.add_parser("coverage", help="audit of HTML files; ends with 1 if one does not pass")
    a.add_argument("input", nargs="+", help="files, folders or patterns; several are audited together")
    a.add_argument("--json", help="payload files of the same names, audited in place of a new parse")
    a.add_argument("--oracle", choices=("naive", "mirror"), default="naive")
    a.add_argument("--no-phantom", action="store_true")
    a.add_argument("--verbose", action="store_true", help="show what is missing, gone, invented or misplaced")
    a.add_argument("--report", help="folder for the rows")
    a = sub.add_parser("batch", help="download, parse and audit links; ends with 1 if one does not pass")
    a.add_argument("--links-file", required=True)
    a.add_argument("--offset", type=int, default=0)
    a.add_argument("--limit", type=int)
    a.add_argument("--oracle", choices=("naive", "mirror"), default="naive")
    a.add_argument("--lang", default="EN")
    a.add_argument("--pages", help="Parquet table (key, html) of pages downloaded before")
    a.add_argument("--parsed", help="Parquet table (doc_id, payload) of documents parsed before")
    a.add_argument("--force-reparse", action="store_true")
    a.add_argument("--out", required=True, help="folder for the results")
    a.add_argument("--snapshot-tag")
    a = sub.add_parser("download", help="one page")
    a.add_argument("url")
    a.add_argument("--name", help="by default taken from the address")
    a.add_argument("--lang", default="EN")
    a.add_argument("--output-dir", default=".")
    a = sub.add_parser("convert-links", help="CSV links to JSON lines")
    a.add_argument("input")
    a.add_argument("output")
    a = sub.add_parser("schemas", help="JSON schemas of payload and validation report")
    a.add_argument("folder")
    a.add_argument("--check", action="store_true", help="write nothing; end with 1 if the files differ")
    return p


def _verdict(rows: DataFrame) -> int:
    failed = rows.where("not passed").count()
    print("PASS" if not failed else f"ISSUES FOUND: {failed} documents")
    return int(failed > 0)


def _parse(spark: SparkSession, args: argparse.Namespace) -> int:
    documents = html_files(spark, args.input).withColumn("celex", F.lit(args.celex).cast("string"))
    pages = spark.read.parquet(args.summaries) if args.summaries and not args.no_summary else None
    parsed = parse_documents(documents, pages, args.summary_lang)
    write_json(parsed.payload(), args.out)
    if not args.no_validation:
        write_json(parsed.validation, args.validation or args.out.rstrip("/") + "-validation")
    for doc, error in parsed.errors.limit(100).collect():
        print(f"{doc}: {error}", file=sys.stderr)
    return _verdict(audit(parsed, args.oracle)) if args.coverage else 0


def _coverage(spark: SparkSession, args: argparse.Namespace) -> int:
    documents = html_files(spark, args.input)
    if args.json:
        rows = audit_payloads(documents, payload_files(spark, args.json), args.oracle, not args.no_phantom)
    else:
        parsed = parse_documents(documents)
        rows = report(parsed, args.oracle) if args.verbose else audit(parsed, args.oracle, not args.no_phantom)
    if args.report:
        write_json(rows, args.report)
    if args.verbose:
        rows.where("not passed").show(20, truncate=100, vertical=True)
    return _verdict(rows)


def _batch(spark: SparkSession, args: argparse.Namespace) -> int:
    table = lambda path: spark.read.parquet(path) if path else None
    links = sliced(links_json(spark, args.links_file), "url", args.offset, args.limit)
    rows = run_batch(links, None, table(args.pages), args.oracle, args.lang, table(args.parsed), args.force_reparse, METHODS)
    write_results(rows, args.out, args.snapshot_tag)
    return _verdict(spark.read.json(f"{args.out}/results").withColumn("passed", F.col("outcome") == "success"))


def _download(spark: SparkSession, args: argparse.Namespace) -> int:
    import os

    from ..functions import text as X

    row = spark.createDataFrame([(args.url,)], "url string").select(X.name_from_url(F.col("url")).alias("name"), X.language_url(F.col("url"), args.lang).alias("url")).first()
    got = fetched(row.url, METHODS)
    if got["ok"]:
        os.makedirs(args.output_dir, exist_ok=True)
        path = os.path.join(args.output_dir, (args.name or row.name) + ".html")
        with open(path, "w", encoding="utf-8") as f:
            f.write(str(got["html"]))
        shown = spark.createDataFrame([(os.path.abspath(path),)], "path string").select(relative_to(F.col("path"), os.getcwd())).first()[0]
        print(f"{got['status']}: {shown}")
        return 0
    print(f"{got['status']}: {got['error']}", file=sys.stderr)
    return 1


def main(argv: list[str] | None = None) -> int:
    args = build().parse_args(argv)
    if args.command == "schemas":
        if args.check:
            stale = check_schemas(args.folder)
            print("out of date: " + ", ".join(stale) if stale else "up to date")
            return int(bool(stale))
        write_schemas(args.folder)
        return 0
    spark = SparkSession.builder.appName("legalspark").getOrCreate()
    if args.command == "convert-links":
        print(f"{convert_links(spark, args.input, args.output)} links")
        return 0
    return {"parse": _parse, "coverage": _coverage, "batch": _batch, "download": _download}[args.command](spark, args)


def run() -> None:
    """Entry point of the console script."""
    sys.exit(main())


if __name__ == "__main__":
    run()
