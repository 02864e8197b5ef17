"""Command line: ``spark-submit -m keepline <step> --workspace <folder> [--input <file>]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from keepline.plans import runs

STEPS = ("verify", "batch", "explore", "prepare", "baseline", "boosted", "attribute", "decide", "customer")


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="keepline", description="Churn analytics and retention decisions")
    parser.add_argument("step", choices=STEPS)
    parser.add_argument("--input", help="raw customer file (verify, batch, explore, prepare)")
    parser.add_argument("--workspace", help="folder for stored tables and models")
    parser.add_argument("--run-id", default="run", help="name of a decision run, or of a batch")
    parser.add_argument("--customer", help="key of the customer to show")
    parser.add_argument("--test", action="store_true", help="trial mode: only the first customers")
    parser.add_argument("--size", type=int, default=10, help="customers in trial mode")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName(f"keepline {args.step}").getOrCreate()
    if args.step == "verify":
        for name, table in runs.verify(spark, args.input).items():
            print(name)
            table.show(30, truncate=False)
    elif args.step == "batch":
        for table in runs.note_batch(spark, args.input, args.workspace, args.run_id).values():
            table.show(50, truncate=False)
    elif args.step == "customer":
        runs.customer(spark, args.workspace, args.run_id, args.customer).show(truncate=False)
    elif args.step == "explore":
        for name, table in runs.explore(spark, args.input, args.workspace).items():
            print(name)
            table.show(30, truncate=False)
    elif args.step == "prepare":
        runs.prepare(spark, args.input, args.workspace).features.groupBy("split").count().show()
    elif args.step == "baseline":
        runs.fit_baseline(spark, args.workspace).show()
    elif args.step == "boosted":
        runs.fit_boosted(spark, args.workspace).show()
    elif args.step == "attribute":
        runs.attribute(spark, args.workspace)["importance"].show(truncate=False)
    else:
        print(runs.run_decisions(spark, args.workspace, args.run_id, args.size if args.test else None)[1])


if __name__ == "__main__":
    main()
