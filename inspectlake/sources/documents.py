"""XML document series.

The source reads plain and gzipped documents alike.  A gzipped document is one
task, so a feed parallelises over its documents (and over the part files of a
document that was split).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectlake.functions.dates import day_from_title, decoded_path, required
from inspectlake.plans.dataset import Dataset
from inspectlake.plans.layout import CORRUPT
from inspectlake.sources.files import document_name, file_version, list_files

DOCUMENT_GLOB = "*.{xml,gz}"

# The envelope element, and the source's name for "any element".
ENVELOPE = "DatovyObsah"
ANY_ELEMENT = "xs_any"

_PREFIX = r"(?:[\w.-]+:)?"


def _reader(spark: SparkSession, row_tag: str, glob: str):
    return (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("ignoreNamespace", True)
        .option("ignoreSurroundingSpaces", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("pathGlobFilter", glob)
    )


def _load(reader, path: str | Sequence[str]) -> DataFrame:
    return reader.load(path if isinstance(path, str) else list(path))


def with_document(scanned: DataFrame, strict: bool = True, versioned: bool = False) -> DataFrame:
    """Add the document's path, name and day, on request the file's version.
    A name without a day is an error unless ``strict`` is off."""
    path = decoded_path(F.col("_metadata.file_path"))
    version = [file_version(scanned).alias("verze")] if versioned else []
    named = scanned.select("*", path.alias("cesta"), document_name(scanned, path).alias("_soubor"), *version)
    day = day_from_title(F.col("_soubor"))
    data = [name for name in scanned.columns if name not in ("soubor", "cast", "den")]
    return named.select(
        *[F.col(f"`{name}`") for name in data],
        "cesta",
        F.col("_soubor").alias("soubor"),
        (required(day, F.col("_soubor")) if strict else day).alias("den"),
        *(["verze"] if versioned else []),
    )


def scan(
    spark: SparkSession,
    dataset: Dataset,
    path: str | Sequence[str],
    glob: str = DOCUMENT_GLOB,
) -> DataFrame:
    """Records of a series as the XML source sees them."""
    return with_document(_load(_reader(spark, dataset.row_tag, glob).schema(dataset.schema), path))


def records(spark: SparkSession, dataset: Dataset, path: str | Sequence[str], glob: str = DOCUMENT_GLOB) -> DataFrame:
    """Clean records of a series; a damaged record is an error here."""
    return dataset.shape(sound(scan(spark, dataset, path, glob)))


def sound(scanned: DataFrame) -> DataFrame:
    """Fail on the first damaged document, naming it and what was read of the
    damaged record.  (Reading that field also keeps the scan from consisting of
    the damage column alone, which the source refuses.)"""
    key = F.coalesce(F.get(F.col(f"`{scanned.columns[0]}`"), 0).cast("string"), F.lit(""))
    message = F.concat(F.lit("damaged document: "), F.col("cesta"), F.lit(" at record "), key)
    return scanned.where(F.col(CORRUPT).isNull() | F.raise_error(message).isNotNull())


# --- one pass over the text ------------------------------------------------------------


def scan_pieces(
    spark: SparkSession,
    dataset: Dataset,
    path: str | Sequence[str],
    glob: str = DOCUMENT_GLOB,
    versioned: bool = False,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Records and what a check needs to know of the text around them, in one pass.

    Columns: those of the series, the document's, ``_poradi`` and ``_znacky``
    (see ``record_texts``).
    """
    options = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": CORRUPT}
    record = F.from_xml("_text", F.lit((schema or dataset.schema).json()), options)
    rows = record_texts(spark, dataset.row_tag, path, glob, versioned)
    beside = [name for name in rows.columns if name != "_text"]
    return rows.select(record.alias("_zaznam"), *beside).select("_zaznam.*", *beside)


def record_texts(
    spark: SparkSession, tag: str, path: str | Sequence[str], glob: str = DOCUMENT_GLOB, versioned: bool = False
) -> DataFrame:
    """The text of every record, ``_text``, with its document.

    The text is cut at the record's end tag, so a row holds one record and what
    precedes it; what follows the last record is a row of its own.  A document
    whose tags have a prefix is one row, all its records are found in it.

    ``_poradi`` is the number of the record in its piece, null where a piece has
    none, and ``_znacky`` tells once per piece of the text around: envelope tags
    opened and closed, record tags, whether the envelope holds an element, names
    left open.  Damaged compression ends a document early.
    """
    reader = spark.read.format("text").option("lineSep", f"</{tag}>").option("pathGlobFilter", glob)
    pieces = with_document(_load(reader.option("ignoreCorruptFiles", True), path), strict=False, versioned=versioned)
    value, envelope = F.col("value"), F.col("value").contains(ENVELOPE)
    opening = rf"<{_PREFIX}{ENVELOPE}(?=[\s/>])"
    closing = rf"</{_PREFIX}{ENVELOPE}\s*>|<{_PREFIX}{ENVELOPE}(?:\s[^>]*)?/>"
    content = rf"<{_PREFIX}{ENVELOPE}(?:\s[^>]*[^>/])?>(?:[^<]|<!--[\s\S]*?-->)*<[\w]"
    whole = rf"(?s)<({_PREFIX}){tag}(?=[\s/>])(?:[^>]*/>|.*?</\1{tag}\s*>)"
    ended = F.concat(value, F.lit(f"</{tag}>"))
    # A piece with one plain record tag needs no expressions: the first tag that begins like it is a plain one,
    # and none follows.  Searched for once a piece and kept, as counting by replacements cost more than parsing.
    at = F.instr(value, f"<{tag}>")
    later = F.call_function("locate", F.lit(f"<{tag}"), value, at + 1)
    lone = (at > 0) & (F.instr(value, f"<{tag}") == at) & (later == 0) & ~value.contains(f":{tag}")
    beside = [name for name in pieces.columns if name != "value"]
    pieces = pieces.withColumn("_misto", F.when(lone, at).otherwise(0))
    place, simple = F.col("_misto"), F.col("_misto") > 0
    found = (
        F.when(place == 1, F.array(ended))
        .when(simple, F.array(F.substring(ended, place, F.length(ended))))
        .otherwise(F.regexp_extract_all(ended, F.lit(whole), F.lit(0)))
    )
    # Tags around the records: names that open and close as often leave 0.
    left = F.regexp_replace(F.regexp_replace(ended, whole, ""), rf"</{tag}>$", "")
    around = F.when(place == 1, "").when(simple, F.substring(value, F.lit(1), place - 1)).when(F.size(found) > 0, left).otherwise(value)
    around = F.when(around.contains("<!"), F.regexp_replace(around, r"<!--[\s\S]*?-->", "")).otherwise(around)
    opens = F.regexp_extract_all(around, F.lit(r"<(\w[^\s/>]*)(?:\s(?:[^>]*[^>/])?)?>"), F.lit(1))
    closes = F.regexp_extract_all(around, F.lit(r"</([^\s>]+)\s*>"), F.lit(1))
    total = lambda names: F.aggregate(names, F.lit(0).cast("long"), lambda n, name: n + F.crc32(name.cast("binary")))
    marks = F.struct(
        (envelope & value.rlike(opening)).alias("opened"),
        (envelope & value.rlike(closing)).alias("closed"),
        (envelope & value.rlike(content)).alias("filled"),
        F.when(simple, 1).otherwise(F.regexp_count(value, F.lit(rf"<{_PREFIX}{tag}(?=[\s/>])"))).alias("tagged"),
        F.when(around.contains("<"), total(opens) - total(closes)).otherwise(F.lit(0).cast("long")).alias("balance"),
    )
    rows = pieces.withColumn("_znacky", marks).select(*beside, "_znacky", F.posexplode_outer(found).alias("_poradi", "_text"))
    once = F.when(F.coalesce("_poradi", F.lit(0)) == 0, F.col("_znacky")).alias("_znacky")
    return rows.select(*beside, "_poradi", once, "_text")


# --- document check ------------------------------------------------------------------


def text_counts(pieces: DataFrame) -> DataFrame:
    """Per file: sound and damaged records, and the tags of its text."""
    damaged, record = F.col(CORRUPT).isNotNull(), F.col("_poradi").isNotNull()
    return pieces.groupBy("cesta").agg(
        F.count_if(record & damaged).alias("damages"),
        F.count_if(record & ~damaged).alias("records"),
        F.count_if("_znacky.opened").alias("opened"),
        F.count_if("_znacky.closed").alias("closed"),
        F.count_if("_znacky.filled").alias("filled"),
        F.sum("_znacky.tagged").alias("tagged"),
        F.sum("_znacky.balance").alias("balance"),
    )


def check_documents(
    spark: SparkSession,
    dataset: Dataset,
    path: str | Sequence[str],
    counts: DataFrame | None = None,
    glob: str = DOCUMENT_GLOB,
) -> DataFrame:
    """One row per file: ``cesta, soubor, den, length, records, status``.

    ``ok``: the envelope is complete and every record tag in the text became a
    record.  ``no_envelope``: the envelope is missing or holds no element.
    ``damaged``: not well-formed, cut short, or fewer records read than tagged.
    Each file is read once; ``counts`` of pieces read already spare that too.
    """
    files = list_files(spark, path, glob).select(_same_form("path").alias("cesta"), "soubor", "den", "length")
    if counts is None:
        first = T.StructType([dataset.schema[0], dataset.schema[CORRUPT]])
        counts = text_counts(scan_pieces(spark, dataset, path, glob, schema=first))
    numbers = ["opened", "closed", "filled", "tagged", "balance", "records", "damages"]
    joined = files.join(counts.withColumn("cesta", _same_form("cesta")), "cesta", "left").na.fill(0, numbers)
    status = (
        F.when((F.col("damages") > 0) | (F.col("records") != F.col("tagged")) | (F.col("balance") != 0), "damaged")
        .when((F.col("opened") > 0) & (F.col("closed") == 0), "damaged")
        .when(F.col("opened") == 0, "no_envelope")
        .when((F.col("records") == 0) & (F.col("filled") == 0), "no_envelope")
        .otherwise("ok")
    )
    return joined.select("cesta", "soubor", "den", "length", "records", status.alias("status"))


def _same_form(column: str):
    """Sources differ in the slashes after the scheme; compare without them."""
    return F.regexp_replace(column, "^([a-z0-9]+):/+", "$1:/")


def require_ok(checked: DataFrame) -> DataFrame:
    """Strict mode: the first document that is not ``ok`` is an error."""
    message = F.concat(F.lit("document is "), F.col("status"), F.lit(": "), F.col("cesta"))
    return checked.where((F.col("status") == "ok") | F.raise_error(message).isNotNull())
