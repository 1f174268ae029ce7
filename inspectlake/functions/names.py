"""Short ids for long column lists: position as three hexadecimal digits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def column_ids(names: Sequence[str]) -> dict[str, str]:
    return {name: format(position, "03x") for position, name in enumerate(names)}


def to_ids(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(column_ids(names))


def from_ids(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({short: name for name, short in column_ids(names).items()})
