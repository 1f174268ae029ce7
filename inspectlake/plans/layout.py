"""Read schemas for records, built from the element paths a plan uses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def record_schema(paths: Iterable[str]) -> T.StructType:
    """Schema for the XML source that keeps every repetition.

    ``A.B.@c`` is attribute ``c`` of element ``B`` inside ``A``.  Elements
    become arrays, so that the first of several can be told from the last.
    """
    tree: dict = {}
    for path in paths:
        node = tree
        for name in path.split("."):
            node = node.setdefault(name, {})
    schema = _struct(tree)
    return schema.add(CORRUPT, T.StringType())


def _struct(tree: dict) -> T.StructType:
    fields = []
    for name, children in tree.items():
        if name.startswith("@"):
            fields.append(T.StructField(f"_{name[1:]}", T.StringType()))
        else:
            item = _struct(children) if children else T.StringType()
            fields.append(T.StructField(name, T.ArrayType(item)))
    return T.StructType(fields)


def fixed_table(text: str) -> list[tuple[str, ...]]:
    """Rows of a table written as text, one row per line."""
    return [tuple(line.split()) for line in text.strip().splitlines()]
