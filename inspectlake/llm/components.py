"""Connected components of an edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectlake.llm.staging import discard, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    return (
        both.join(least, F.col("a") == F.col("n"))
        .filter("b > a")
        .select(F.col("b").alias("a"), F.least("n", "m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the smallest of them."""
    down = edges.selectExpr("greatest(a, b) as a", "least(a, b) as b")
    least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = down.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each node of ``edges`` (a, b: long) that is not itself the smallest of its component.

    Each round is a written table, so nothing hangs on a long lineage; joins on
    a node with very many edges are sort-merge joins whose sides split.
    """
    held, seen = stage(edges.filter("a != b").distinct(), "edges"), None
    while True:
        mark = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            return held.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = mark
        after = stage(_small_star(_large_star(held)).filter("a != b").distinct(), "edges")
        discard(held)
        held = after
