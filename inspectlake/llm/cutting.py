"""Cuts and positions along a seeded order of rows, whatever the size of a group.

A group of n rows is cut into about sqrt(n) / 2 ranges of a seeded hash.  Range totals
come from partial aggregation; only ranges, or the rows of one range, ever meet
in a task, so a group with a third of all rows is as cheap as any other.  The
hash has to differ between rows, also of one key (``dealing``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inspectlake.llm.staging import free

CUTS = "array<struct<name: string, low: long, high: long>>"


def _ranges(df: DataFrame, group: str, order: str, weight: str, part: str, start: str, total: str):
    """``df`` with its range, and the ranges with total weight and the weight before them."""
    (count,) = free("count", among=df.columns)
    counts = df.groupBy(F.col(group).alias("count_group")).agg(F.count("*").alias(count))
    spread = F.col(order) / F.lit(2.0**64) + F.lit(0.5)
    ranges = F.greatest(F.lit(1), F.round(F.sqrt(F.col(count)) / 2))
    split = df.join(counts, F.col(group).eqNullSafe(F.col("count_group"))).select(
        *df.columns, F.floor(spread * ranges).cast("int").alias(part)
    )
    sums = split.groupBy(group, part).agg(F.sum(weight).alias(total))
    before = f"sum(`{total}`) over (partition by `{group}` order by `{part}` rows between unbounded preceding and 1 preceding)"
    return split, sums.withColumn(start, F.expr(f"coalesce({before}, 0)"))


def _joined(split: DataFrame, ranges: DataFrame, group: str, part: str) -> DataFrame:
    side = ranges.withColumnsRenamed({group: "range_group", part: "range_part"})
    same = F.col(group).eqNullSafe(F.col("range_group")) & (F.col(part) == F.col("range_part"))
    return split.join(side, same).drop("range_group", "range_part")


def number(df: DataFrame, group: str, order: str, key: str, slot: str) -> DataFrame:
    """Add ``slot``: gapless from 0 within each group, along the hash ``order`` and then ``key``."""
    part, start, total, one = free("part", "start", "total", "one", among=[*df.columns, slot])
    split, ranges = _ranges(df.withColumn(one, F.lit(1)), group, order, one, part, start, total)
    within = f"row_number() over (partition by `{group}`, `{part}` order by `{order}`, `{key}`) - 1"
    own = [c for c in df.columns if c != slot]
    return _joined(split.withColumn(slot, F.expr(within)), ranges, group, part).select(
        *own, (F.col(slot) + F.col(start)).cast("long").alias(slot)
    )


def divide(
    df: DataFrame, group: str, order: str, key: str, weight: str, plan: DataFrame, levels: int, out: str
) -> DataFrame:
    """Add ``out``: the names of the cuts that each row falls into, one for each level at most.

    ``plan`` (group, size, cuts) gives for each group its total weight and
    intervals along its order, which is gone through ``levels`` times.  Ranges
    inside one interval take its name as a whole.  The rows of a range that
    holds a border are shared out so that the weights come near the parts: the
    heaviest first, each to the part with the most room.
    """
    part, start, total, size, cuts, whole, names = free(
        "part", "start", "total", "size", "cuts", "whole", "names", among=[*df.columns, out]
    )
    split, ranges = _ranges(df, group, order, weight, part, start, total)
    side = plan.select(F.col("group").alias("plan_group"), F.col("size").alias(size), F.col("cuts").alias(cuts))
    low, high = f"`{start}` + k * `{size}`", f"`{start}` + `{total}` + k * `{size}`"
    touch = f"filter(`{cuts}`, c -> c.low < {high} and c.high > {low})"
    inside = f"(size({touch}) = 0 or (size({touch}) = 1 and {touch}[0].low <= {low} and {touch}[0].high >= {high}))"
    steps = f"sequence(0, {levels - 1})"
    ranges = ranges.join(side, F.col(group).eqNullSafe(F.col("plan_group")), "left").select(
        *ranges.columns, size, F.expr(f"coalesce(`{cuts}`, cast(array() as {CUTS}))").alias(cuts)
    )
    ranges = ranges.withColumn(whole, F.expr(f"forall({steps}, k -> {inside})")).withColumn(
        names, F.expr(f"transform(flatten(transform({steps}, k -> {touch})), c -> c.name)")
    )
    own = [c for c in df.columns if c != out]
    rows = _joined(split, ranges, group, part)
    plain = rows.filter(F.col(whole)).select(*own, F.col(names).alias(out))
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)

    def share(rows: pa.Table) -> pa.Table:
        first = {c: rows[c][0].as_py() for c in (start, total, size, cuts)}
        weights, hashes, keys = (rows[c].to_pylist() for c in (weight, order, key))
        turn = sorted(range(rows.num_rows), key=lambda i: (-weights[i], hashes[i], keys[i] is None, keys[i]))
        names: list[list] = [[] for _ in turn]
        for k in range(levels):
            low = first[start] + k * first[size]
            parts = []
            for c in first[cuts]:
                room = min(c["high"], low + first[total]) - max(c["low"], low)
                if room > 0:
                    parts.append([room, c["name"]])
            rest = [first[total] - sum(room for room, _ in parts)]
            for i in turn:
                most = max(parts, key=lambda p: p[0], default=rest)
                if most is rest or rest[0] > most[0]:
                    rest[0] -= weights[i]
                else:
                    most[0] -= weights[i]
                    names[i].append(most[1])
        kept = rows.select([c for c in rows.column_names if c in own])
        return kept.append_column(out, pa.array(names, pa.list_(pa.string()))).select(arrow.names).cast(arrow)

    border = rows.filter(~F.col(whole)).select(*own, part, start, total, size, cuts)
    return plain.unionByName(border.groupBy(group, part).applyInArrow(share, schema))
