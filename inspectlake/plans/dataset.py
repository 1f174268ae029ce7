"""What the generic ingest must know about one document series."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Columns that tie a row to its document and, in ingested tables, to the
#: version of the file it came from; every target table is partitioned by them,
#: so a day can be pruned and a file's rows seen or not as a whole.
DOCUMENT_COLUMNS = ("den", "soubor", "verze")


@dataclass(frozen=True)
class Dataset:
    """A document series: how its records are read and which tables they feed.

    ``shape`` turns scanned XML rows into clean records and drops the rows the
    series does not accept; each entry of ``tables`` projects clean records to
    the rows of one target table.  The first table is the parent.  ``lookups``
    are columns that rows are looked up by, one value at a time.  ``sums`` are
    tables of sums that add up over files, kept like the others by file version:
    a corrected file takes its old sums back by bringing new ones.
    """

    name: str
    row_tag: str
    schema: T.StructType
    shape: Callable[[DataFrame], DataFrame]
    tables: Mapping[str, Callable[[DataFrame], DataFrame]]
    lookups: Sequence[str] = ()
    sums: Mapping[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    @property
    def targets(self) -> dict[str, Callable[[DataFrame], DataFrame]]:
        """All tables an ingest writes."""
        return {**self.tables, **self.sums}

    @property
    def parent(self) -> str:
        return next(iter(self.tables))


def document_columns(df: DataFrame) -> list[str]:
    return [name for name in DOCUMENT_COLUMNS if name in df.columns]
