"""Delimited text files that follow no strict rules."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectlake.functions.dates import decoded_path, file_stem
from inspectlake.sources.files import literal_path

_NO_QUOTE = ""


def _reader(spark: SparkSession, separator: str):
    return (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("quote", _NO_QUOTE)
        .option("escape", _NO_QUOTE)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", True)
    )


def scan_tolerant(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Header, no quoting, every column as text.  Fields beyond the header are
    cut off, missing ones are null."""
    names = _reader(spark, separator).csv(path).columns
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return _reader(spark, separator).schema(schema).csv(path)


def with_stem_ending(listing: DataFrame, ending: str) -> DataFrame:
    return listing.where(file_stem(F.col("path")).endswith(ending))


def headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``cesta, hlavicka``: the first line of every file that has one, found by one job over all of them."""
    lines = spark.read.text(list(map(literal_path, paths))).select(
        "value", decoded_path(F.col("_metadata.file_path")).alias("cesta"), F.col("_metadata.file_block_start").alias("start")
    )
    # Ids rise along a split, and the first line lies in the first one.
    first = lines.where("start = 0").withColumn("n", F.monotonically_increasing_id())
    return first.groupBy("cesta").agg(F.min_by("value", "n").alias("hlavicka"))


def _names(header: str, separator: str) -> list[str]:
    """Column names of a header line; nameless and repeated ones get their number, as in Spark's own reader."""
    cells = next(csv.reader([header], delimiter=separator), [])
    low = [cell.lower() for cell in cells]
    return [f"_c{i}" if not cell else f"{cell}{i}" if low.count(cell.lower()) > 1 else cell for i, cell in enumerate(cells)]


def stack(spark: SparkSession, paths: Sequence[str], separator: str = ";") -> DataFrame:
    """Rows of all files, matched by column name; a column a file lacks is null.

    One job finds the headers of all files; files that share one are read by one
    scan.  So jobs do not grow with the number of files, and the plan only with
    the number of different headers.  The driver sees names and headers.
    """
    groups = headers(spark, paths).groupBy("hlavicka").agg(F.sort_array(F.collect_list("cesta")).alias("cesty"))
    scans = []
    for row in groups.orderBy("hlavicka").collect():
        schema = T.StructType([T.StructField(name, T.StringType()) for name in _names(row["hlavicka"], separator)])
        reader = spark.read.option("header", True).option("sep", separator).schema(schema)
        scans.append(reader.csv(list(map(literal_path, row["cesty"]))))
    if not scans:
        return spark.createDataFrame([], T.StructType())
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), scans)
