"""Command line: python -m rosterlake QUERY SF_DIR [OUT]; without arguments the names of all queries."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from rosterlake.plans.catalogue import QUERIES

    if len(args) < 2:
        print("\n".join(sorted(QUERIES)))
        return 0
    if args[0] not in QUERIES:
        print(f"no query {args[0]}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from rosterlake.sources.sinks import write_table

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    df = QUERIES[args[0]](spark, args[1])
    if len(args) > 2:
        write_table(df, args[2])
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
