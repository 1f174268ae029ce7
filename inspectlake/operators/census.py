"""Structural census: which elements occur below a path."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import suppress
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectlake.functions.dates import decoded_path
from inspectlake.functions.elements import descend, member
from inspectlake.sources.documents import DOCUMENT_GLOB


def scan_children(
    spark: SparkSession, path: str | Sequence[str], row_tag: str, element: str, glob: str = DOCUMENT_GLOB
) -> DataFrame:
    """``cesta, deti``: per record the child names of the element at a dotted
    path below it, null where the record has no such element.

    The element is read as a map, whose keys are the local names of its
    children; nothing else of the record is kept.
    """
    *way, last = element.split(".")
    field = T.StructType([T.StructField(last, T.MapType(T.StringType(), T.StringType()))])
    for name in reversed(way):
        field = T.StructType([T.StructField(name, T.ArrayType(field))])
    reader = (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("ignoreNamespace", True)
        .option("attributePrefix", "@")
        .option("pathGlobFilter", glob)
        .schema(field)
    )
    scanned = reader.load(path if isinstance(path, str) else list(path))
    names = F.filter(F.map_keys(F.expr(member(descend(None, *way), last))), lambda name: ~name.startswith("@"))
    return scanned.select(decoded_path(F.col("_metadata.file_path")).alias("cesta"), names.alias("deti"))


def structure_paths(texts: DataFrame) -> DataFrame:
    """Every element and attribute path below a record (``A/B``, ``A/B/@c``), with records and documents it occurs in.

    Takes ``soubor`` and ``_text``; prefixes of names are dropped.  A record that
    is not well-formed counts with what stands before its damage.  Paths are
    counted where the records lie; only sums per path and document are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for document, text in zip(batch.column("soubor").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                counts.update((document, path) for path in _paths(text))
            documents, paths = zip(*counts, strict=True) if counts else ((), ())
            columns = [pa.array(documents, pa.string()), pa.array(paths, pa.string()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["soubor", "cesta", "zaznamu"])

    found = texts.where("_text IS NOT NULL").select("soubor", "_text").mapInArrow(run, "soubor string, cesta string, zaznamu long")
    per_document = found.groupBy("cesta", "soubor").agg(F.sum("zaznamu").alias("zaznamu"))
    return per_document.groupBy("cesta").agg(F.sum("zaznamu").alias("zaznamu"), F.count("*").alias("souboru"))


def _paths(text: str) -> set[str]:
    found: set[str] = set()
    where: list[str] = []

    def start(name: str, attributes: dict[str, str]) -> None:
        own = name.rpartition(":")[2]
        where.append(f"{where[-1]}/{own}" if where else own)
        found.add(where[-1])
        found.update(f"{where[-1]}/@{a}" for a in attributes)

    parser = expat.ParserCreate()
    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: where.pop()
    with suppress(expat.ExpatError):
        parser.Parse(text, True)
    return found


def child_names(children: DataFrame) -> DataFrame:
    """Each distinct name with the number of records and files it occurs in."""
    # Counted per name and file first: the second step then sees one row per
    # name and file, however common a name is.
    per_file = children.select("cesta", F.explode("deti").alias("element")).groupBy("element", "cesta").count()
    return per_file.groupBy("element").agg(F.sum("count").alias("zaznamu"), F.count("*").alias("souboru"))


def child_counts(children: DataFrame) -> DataFrame:
    """How many records have how many distinct child names."""
    return (
        children.where("deti IS NOT NULL").groupBy(F.size("deti").alias("pocet_deti")).agg(F.count("*").alias("zaznamu"))
    )
