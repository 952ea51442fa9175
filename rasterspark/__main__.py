"""``python -m rasterspark PATH`` or ``rasterspark PATH``: the headers of the containers below a path, as JSON lines."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .sources import reader


def main(path: str) -> None:
    spark = SparkSession.builder.appName("rasterspark").getOrCreate()
    rows = reader.images(reader.read_files(spark, path)).drop("custom_fields")
    for row in rows.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
        print(row["line"])


def run() -> None:
    if len(sys.argv) != 2:
        sys.exit("usage: rasterspark PATH")
    main(sys.argv[1])


if __name__ == "__main__":
    run()
