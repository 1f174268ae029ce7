"""Parent and child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents, key)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is missing."""
    return children.join(parents.select(key), key, "left_anti")


def childless(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key), key, "left_anti")


def integrity(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """One row: how many parents have children, have none, and how many child
    rows have no parent.  Children are counted per key before the join, so one
    key with very many rows stays small."""
    counted = children.groupBy(key).agg(F.count("*").alias("deti"))
    joined = parents.select(key, F.lit(1).alias("rodic")).join(counted, key, "full")
    return joined.agg(
        F.count_if(F.col("rodic").isNotNull() & F.col("deti").isNotNull()).alias("rodicu_s_detmi"),
        F.count_if(F.col("rodic").isNotNull() & F.col("deti").isNull()).alias("rodicu_bez_deti"),
        F.coalesce(F.sum(F.when(F.col("rodic").isNull(), F.col("deti"))), F.lit(0)).alias("deti_bez_rodice"),
    )
