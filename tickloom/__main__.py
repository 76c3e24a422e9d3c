"""python -m tickloom --data=FOLDER [--universe=NAME|FILE] [--step=N] [--warmup=N] [--buffer=N] [--horizons=A,B,...] [--until=DATE] [--out=FOLDER] QUERY ...

Runs the named queries and writes each to a folder of its name below --out, or prints its first rows.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tickloom.plans.catalogue import QUERIES
from tickloom.run import from_arguments
from tickloom.sources.publish import publish


def main(arguments: list[str]) -> int:
    try:
        run, names, out = from_arguments(arguments)
        if unknown := [n for n in names if n not in QUERIES]:
            raise ValueError(f"no such query: {', '.join(unknown)}")
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name in names:
        result = QUERIES[name](spark, run)
        if out:
            publish(result, f"{out}/{name}")
        else:
            result.show()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
