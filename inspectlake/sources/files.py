"""File listings, day sets and work lists.

Listings come from the ``binaryFile`` source without its content column, so
only metadata is read.  A feed may be laid out flat (``<title>
dd-mm-yyyy.xml[.gz]``) or as partition folders ``soubor=<title> dd-mm-yyyy``
that hold any number of part files; both give the same ``soubor``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectlake.functions.dates import (
    day_from_path,
    day_from_title,
    decoded_path,
    file_name,
    required,
    title_text,
)

LISTING = "path string, length long"


def document_name(df: DataFrame, path: Column) -> Column:
    """Name of the document a file belongs to."""
    if "soubor" in df.columns:
        return F.col("soubor").cast("string")
    folder = F.nullif(F.regexp_extract(path, "/soubor=([^/]+)/", 1), F.lit(""))
    return F.coalesce(folder, title_text(file_name(path)))


def list_files(spark: SparkSession, directory: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Files below one or more directories: ``path, length, soubor, den``.

    ``den`` is null for a name without a day.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", False)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listed = reader.load(directory if isinstance(directory, str) else list(directory))
    soubor = document_name(listed, F.col("path"))
    return listed.select("path", "length", soubor.alias("soubor")).withColumn("den", day_from_title(F.col("soubor")))


def file_version(df: DataFrame) -> Column:
    """A file as it is now: its path, size and time of change, as one short text."""
    parts = (
        same_form(F.col("_metadata.file_path")),
        F.col("_metadata.file_size").cast("string"),
        F.unix_millis(F.col("_metadata.file_modification_time")).cast("string"),
    )
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 20)


def list_versions(spark: SparkSession, directory: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Files at any depth: ``path, cesta, soubor, den, verze``; two files of one name stay two."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listed = reader.load(directory if isinstance(directory, str) else list(directory))
    soubor = document_name(listed, decoded_path(F.col("_metadata.file_path")))
    cesta = same_form(F.col("_metadata.file_path"))
    return listed.select("path", cesta.alias("cesta"), soubor.alias("soubor"), file_version(listed).alias("verze")).withColumn(
        "den", day_from_title(F.col("soubor"))
    )


def same_form(path: Column) -> Column:
    """Sources differ in escapes and in the slashes after the scheme; compare without them."""
    return F.regexp_replace(decoded_path(path), "^([a-z0-9]+):/+", "$1:/")


def literal_path(path: str) -> str:
    """A listed path for a reader, which would take some characters as a glob."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def count_files(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count("*").alias("files"))


def existing_directories(spark: SparkSession, directories: Iterable[str]) -> list[str]:
    """The directories that exist, in any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for directory in directories:
        path = jvm.org.apache.hadoop.fs.Path(directory)
        if path.getFileSystem(conf).exists(path):
            found.append(directory)
    return found


def ingested_days(
    spark: SparkSession,
    directories: Iterable[str],
    rule: Callable[[Column], Column] = day_from_path,
) -> DataFrame:
    """Distinct days named by the files of several directories.

    Absent directories are skipped and names without a day ignored.  The
    default rule drops one suffix only, so ``… .xml.gz`` names no day; pass
    another rule to count those too.
    """
    days = [
        spark.read.format("binaryFile").load(directory).select(rule(F.col("path")).alias("den"))
        for directory in existing_directories(spark, directories)
    ]
    if not days:
        return spark.createDataFrame([], "den date")
    return reduce(DataFrame.union, days).where("den is not null").distinct()


def work_list(listing: DataFrame) -> DataFrame:
    """Documents in order of their day; a name without a day is an error."""
    return listing.withColumn("den", required(F.col("den"), F.col("path"))).orderBy("den", "path")


def pending(listing: DataFrame, processed: DataFrame, on: str | Sequence[str] = "den") -> DataFrame:
    """Listed documents that are not among the processed ones."""
    return listing.join(processed, on, "left_anti")


def sample_files(listing: DataFrame, count: int, seed: int) -> DataFrame:
    """A repeatable random choice of files, for a look at a part of a feed.

    The document's name decides, so the choice is the same wherever the feed lies.
    """
    return listing.orderBy(F.md5(F.concat_ws("|", F.coalesce("soubor", "path"), F.lit(seed))), "path").limit(count)


def _open(path: str):
    """A listed file as a stream, in the local or a remote file system."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if colon and scheme != "file":
        system, where = fs.FileSystem.from_uri(quote(path, safe=":/=@"))
    else:
        system, where = fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon else path
    return system.open_input_file(where)


def _first_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for batch in batches:
        errors = []
        for path in batch["path"]:
            try:
                with _open(path) as source:
                    next(pq.ParquetFile(source).iter_batches(batch_size=1), None)
                errors.append(None)
            except Exception as problem:  # any failure to read is the finding
                errors.append(str(problem))
        yield batch.assign(error=errors)


def _untyped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow as pa
    import pyarrow.parquet as pq

    for batch in batches:
        names = []
        for path in batch["path"]:
            with _open(path) as source:
                schema = pq.read_schema(source)
            names.append([field.name for field in schema if pa.types.is_null(field.type)])
        yield batch.assign(columns=names)


def untyped_columns(listing: DataFrame) -> DataFrame:
    """Per parquet file the columns its writer left without a type because they
    held nulls only.  Only footers are read, on the executors."""
    return listing.select("path").mapInPandas(_untyped, "path string, columns array<string>")


def audit_parquet(listing: DataFrame) -> DataFrame:
    """Try one row of every listed file on the executors; ``error`` is null
    for a readable file."""
    return listing.select("path").mapInPandas(_first_rows, "path string, error string")


def unreadable_files(listing: DataFrame) -> DataFrame:
    return audit_parquet(listing).where("error is not null")
