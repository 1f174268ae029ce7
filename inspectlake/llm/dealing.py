"""Hashes that deal out rows also where many rows have the same key or none.

The first row of a key in a partition has the plain hash of its key, so a table
of distinct keys is dealt alike however it is split.  Further rows of the key,
and rows without one, are salted by their count in the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def salted(df: DataFrame, key: str, salt: str) -> DataFrame:
    """Add ``salt`` (long); write the result before it is read more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        met: dict[object, int] = {None: 1}
        for batch in batches:
            salts = []
            for k in batch.column(key).to_pylist():
                n = met.get(k, 0)
                met[k] = n + 1
                salts.append(first + n if n else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(salts, pa.int64())], names=[*batch.schema.names, salt])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(salt, T.LongType())]))


def dealt(seed: int, salt: str, *columns: str) -> Column:
    """The hash of the columns, with the salt where there is one."""
    plain = [F.lit(seed), *(F.col(c) for c in columns)]
    return F.when(F.col(salt) == 0, F.xxhash64(*plain)).otherwise(F.xxhash64(*plain, F.col(salt)))
