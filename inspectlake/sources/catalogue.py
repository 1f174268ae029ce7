"""Catalogue of a document series as triples ``s, p, o, lang``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectlake.functions.dates import day_from_title, required, within
from inspectlake.sources.files import pending

# Predicates of the catalogue vocabulary and the title language.
SERIES_MEMBER = "http://www.w3.org/ns/dcat#seriesMember"
DISTRIBUTION = "http://www.w3.org/ns/dcat#distribution"
TITLE = "http://purl.org/dc/terms/title"
DOWNLOAD_URL = "http://www.w3.org/ns/dcat#downloadURL"
LANGUAGE = "cs"


def _edges(triples: DataFrame, predicate: str, subject: str, value: str) -> DataFrame:
    return triples.where(F.col("p") == predicate).select(F.col("s").alias(subject), F.col("o").alias(value))


def list_series(triples: DataFrame, series: str | None = None, language: str = LANGUAGE) -> DataFrame:
    """``series, title, url`` of every downloadable file; one row per match.

    All joins are equi-joins on resource ids.  Titles are joined before the
    distributions, the larger side, and sizes decide on broadcasts.
    """
    members = _edges(triples, SERIES_MEMBER, "series", "dataset")
    if series is not None:
        members = members.where(F.col("series") == series)
    titles = _edges(triples.where(F.col("lang") == language), TITLE, "dataset", "title")
    distributions = _edges(triples, DISTRIBUTION, "dataset", "distribution")
    urls = _edges(triples, DOWNLOAD_URL, "distribution", "url")
    return (
        members.join(titles, "dataset")
        .join(distributions, "dataset")
        .join(urls, "distribution")
        .select("series", "title", "url")
    )


def to_fetch(
    listed: DataFrame, start: Column, end: Column | None = None, processed: DataFrame | None = None
) -> DataFrame:
    """Listed files of the interval whose day is not processed yet.

    A title without a day is an error; processed days come as ``den``.
    """
    dated = listed.withColumn("den", required(day_from_title(F.col("title")), F.col("title")))
    wanted = dated.where(within(F.col("den"), start, end))
    return wanted if processed is None else pending(wanted, processed.select("den").distinct())
