"""Command line for the whole jobs: ``python -m reviewmill etl|rows|chunks|search|evaluate ...``."""

from __future__ import annotations

import argparse

from reviewmill.fixed import SERVICE_K
from reviewmill.plans import jobs
from reviewmill.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="reviewmill")
    commands = parser.add_subparsers(dest="command", required=True)
    etl = commands.add_parser("etl", help="review files to processed tables and reports")
    etl.add_argument("raw")
    etl.add_argument("out")
    etl.add_argument("--metadata")
    etl.add_argument("--run-id", default="")
    etl.add_argument("--at", default="", help="time stamp of the reports, the present time if left out")
    rows = commands.add_parser("rows", help="processed reviews to the keyed vector table")
    rows.add_argument("processed")
    rows.add_argument("table")
    rows.add_argument("--version", type=int, required=True, help="larger versions win")
    chunks = commands.add_parser("chunks", help="processed reviews to chunk vectors")
    chunks.add_argument("processed")
    chunks.add_argument("out")
    search = commands.add_parser("search", help="best stored reviews of every question")
    search.add_argument("table")
    search.add_argument("questions", help="text, one question a line")
    search.add_argument("out")
    search.add_argument("--k", type=int, default=SERVICE_K)
    search.add_argument("--where", action="append", default=[], metavar="FIELD=VALUE", help="several values of a field: any")
    scores = commands.add_parser("evaluate", help="answer and score questions with known keywords")
    scores.add_argument("table")
    scores.add_argument("gold", help='JSON lines: {"question": ..., "keywords": [...]}')
    scores.add_argument("out")
    scores.add_argument("--k", type=int, default=SERVICE_K)
    args = parser.parse_args()

    spark = build_session(f"reviewmill-{args.command}")
    if args.command == "etl":
        jobs.run_etl(spark, args.raw, args.out, args.metadata, args.run_id, args.at)
    elif args.command == "rows":
        processed = spark.read.parquet(args.processed)
        print(jobs.run_row_index(spark, processed, args.table, args.version))
    elif args.command == "search":
        lines = spark.read.text(args.questions).where("trim(value) <> ''").withColumnRenamed("value", "question")
        filters: dict[str, list[str]] = {}
        for pair in args.where:
            name, _, value = pair.partition("=")
            filters.setdefault(name, []).append(value)
        jobs.run_search(lines, args.table, args.out, args.k, filters)
    elif args.command == "evaluate":
        gold = spark.read.schema("question string, keywords array<string>").json(args.gold)
        print(jobs.run_evaluate(gold, args.table, args.out, args.k).first().asDict())
    else:
        print(jobs.run_chunk_index(spark.read.parquet(args.processed), args.out))


if __name__ == "__main__":
    main()
