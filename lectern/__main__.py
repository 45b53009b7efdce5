"""Run a registered query and write its result.

    python -m lectern --list
    python -m lectern <query> <tables_dir> <output_path> [--format parquet|json] [--partition-by COL]

The session is taken with ``getOrCreate``, so when this module is
launched by ``spark-submit`` (or inside an existing session) the
cluster's settings apply.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lectern.plans import catalog
from lectern.session import configure, remove_intermediate


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="python -m lectern")
    ap.add_argument("--list", action="store_true", help="list the registered queries")
    ap.add_argument("query", nargs="?")
    ap.add_argument("tables_dir", nargs="?")
    ap.add_argument("output", nargs="?")
    ap.add_argument("--format", default="parquet", choices=["parquet", "json"])
    ap.add_argument("--partition-by", default=None)
    args = ap.parse_args(argv)
    queries = catalog.queries()
    if args.list:
        for name, fn in sorted(queries.items()):
            print(f"{name:28s} {(fn.__doc__ or '').strip().splitlines()[0]}")
        return 0
    if not (args.query and args.tables_dir and args.output):
        ap.error("query, tables_dir and output are required")
    if args.query not in queries:
        ap.error(f"unknown query {args.query!r}; see --list")
    spark = SparkSession.builder.appName(f"lectern-{args.query}").getOrCreate()
    configure(spark)
    writer = queries[args.query](spark, args.tables_dir).write.mode("overwrite")
    if args.partition_by:
        writer = writer.partitionBy(args.partition_by)
    writer.format(args.format).save(args.output)
    remove_intermediate(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
