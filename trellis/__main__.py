"""python -m trellis QUERY FOLDER [ROWS]: runs a registered query on a folder of tables; without arguments, lists them."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .catalog import QUERIES


def main(args: list[str]) -> int:
    if not args:
        print("\n".join(sorted(QUERIES)))
        return 0
    if args[0] not in QUERIES or len(args) < 2:
        print(__doc__ if args[0] in QUERIES else f"no query {args[0]!r}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    QUERIES[args[0]](spark, args[1]).show(int(args[2]) if len(args) > 2 else 20, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
