"""python -m quillspark QUERY FOLDER [--rows N]: runs a registered query on the tables of a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quillspark.plans import registry


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    parser.add_argument("query", choices=sorted(registry.queries()))
    parser.add_argument("folder")
    parser.add_argument("--rows", type=int, default=20)
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    registry.queries()[asked.query](spark, asked.folder).show(asked.rows, truncate=False)


if __name__ == "__main__":
    main()
