"""Commands: list the queries, print a query's SQL, show its plan, run it to a folder or the screen.

    python -m rasterloom list
    python -m rasterloom sql NAME
    python -m rasterloom explain NAME --data FOLDER
    python -m rasterloom run NAME --data FOLDER [--out FOLDER] [--format parquet|json|csv] [--rows 20]
"""

from __future__ import annotations

import argparse
import sys

from . import catalogue


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rasterloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("list", "sql", "explain", "run"))
    parser.add_argument("name", nargs="?")
    parser.add_argument("--data")
    parser.add_argument("--out")
    parser.add_argument("--format", default="parquet", choices=("parquet", "json", "csv"))
    parser.add_argument("--rows", type=int, default=20)
    asked = parser.parse_args(arguments)
    if asked.command == "list":
        for name in sorted(catalogue.QUERIES):
            print(name, "(SQL)" if name in catalogue.ORACLES else "")
        return 0
    if asked.name not in catalogue.QUERIES:
        print(f"no query {asked.name}", file=sys.stderr)
        return 2
    if asked.command == "sql":
        print(catalogue.ORACLES.get(asked.name, f"-- {asked.name} has no SQL"))
        return 0
    if not asked.data:
        parser.error("--data is needed")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("rasterloom").getOrCreate()
    rows = catalogue.QUERIES[asked.name](spark, asked.data)
    if asked.command == "explain":
        rows.explain("formatted")
    elif asked.out:
        rows.write.mode("overwrite").format(asked.format).save(asked.out)
    else:
        rows.show(asked.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
