"""XML text as SQL expressions, for feeds made out of tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectlake.functions.elements import literal

#: A literal and nothing else.
_LITERAL = re.compile(r"'(?:[^'\\]|\\.)*'", re.DOTALL)


class Joined(str):
    """A ``concat`` that knows its parts, so that one around it takes them up."""

    parts: tuple[str, ...]


def joined(*parts: str) -> str:
    """Texts one after the other; neighbouring literals become one, as every part costs time in every row."""
    merged: list[str] = []
    for part in _parts(parts):
        if merged and _LITERAL.fullmatch(part) and _LITERAL.fullmatch(merged[-1]):
            merged[-1] = merged[-1][:-1] + part[1:]
        else:
            merged.append(part)
    result = Joined(f"concat({', '.join(merged)})")
    result.parts = tuple(merged)
    return result


def _parts(parts: tuple[str, ...]) -> Iterator[str]:
    for part in parts:
        if isinstance(part, Joined):
            yield from part.parts
        elif part != "''":
            yield part


def tag(name: str, *content: str, attributes: dict[str, str] | None = None) -> str:
    """An element around SQL expressions; attributes are expressions too."""
    opening = [literal(f"<{name}")]
    for key, value in (attributes or {}).items():
        opening += [literal(f' {key}="'), value, literal('"')]
    if not content:
        return joined(*opening, literal("/>"))
    return joined(*opening, literal(">"), *content, literal(f"</{name}>"))


def only_if(condition: str, content: str) -> str:
    return f"CASE WHEN {condition} THEN {content} ELSE '' END"


def many(count: str, variable: str, item: str) -> str:
    """``item`` repeated ``count`` times; ``variable`` numbers it from zero."""
    numbers = f"filter(sequence(0, greatest(CAST({count} AS int), 1) - 1), x -> x < {count})"
    return f"array_join(transform({numbers}, {variable} -> {item}), '')"


#: Compressing took a third of the time a feed takes; the fastest level makes its files half as large again.
GZIP_LEVEL = "BEST_SPEED"

#: Records per file.  A document with more is split into several part files.
RECORDS_PER_FILE = 25_000


def write_feed(
    spark: SparkSession,
    rows: DataFrame,
    key: str,
    record: str,
    list_name: str,
    namespace: str,
    target: str,
    least_parts: int = 1,
) -> str:
    """Write ``rows`` (with their document name in ``soubor``) as gzipped XML.

    The text is built after the shuffle, so only the source columns move; the
    partition count is explicit, as the text is many times their size.  A
    document is cut into part files by its own row count, so one day that
    holds a large share of all rows is still written by many tasks; it has
    ``least_parts`` at least.
    """
    opening = (
        '<?xml version="1.0" encoding="utf-8"?>\n'
        '<DatovaSada xmlns="istp:opendata:schemas:DatovaSada:v1"><DatovyObsah>'
        f'<{list_name} xmlns="{namespace}">'
    )
    closing = f"</{list_name}></DatovyObsah></DatovaSada>"
    parts = rows.groupBy("soubor").agg(F.greatest(F.ceil(F.count("*") / RECORDS_PER_FILE), F.lit(least_parts)).cast("int").alias("kusu"))
    # One row per document on the right; Spark broadcasts it if it is small.
    numbered = rows.join(parts, "soubor").withColumn(
        "kus", F.pmod(F.xxhash64(key), F.col("kusu")).cast("int")
    )
    edges = parts.select("soubor", F.explode(F.sequence(F.lit(0), F.col("kusu") - 1)).alias("kus")).select(
        "soubor", "kus", F.explode(F.array(F.lit(0), F.lit(2))).alias("poradi")
    )
    lines = (
        numbered.drop("kusu")
        .withColumn("poradi", F.lit(1))
        .unionByName(edges, allowMissingColumns=True)
        .withColumn("soubor", F.coalesce("soubor", F.lit("-")))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "soubor", "kus")
        .sortWithinPartitions("soubor", "kus", "poradi")
    )
    text = F.when(F.col("poradi") == 0, opening).when(F.col("poradi") == 2, closing).otherwise(F.expr(record))
    (
        lines.select("soubor", "kus", text.alias("value"))
        .write.partitionBy("soubor", "kus")
        .option("compression", "gzip")
        .option("zlib.compress.level", GZIP_LEVEL)
        .mode("overwrite")
        .text(target)
    )
    return target
