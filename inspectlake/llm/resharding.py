"""Resharding by minimum-cost flow: the fewest bytes that even out the shards.

Only totals of the old shards reach the driver.  The flow says how many bytes
go from each old shard to each new one, where staying is free and moving costs
a unit a byte.  Each old shard is then cut along a seeded order of its
documents: the block that stays first, then a block for each receiver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectlake.llm.cutting import CUTS, divide, number
from inspectlake.llm.dealing import dealt, salted
from inspectlake.llm.flow import min_cost_flow
from inspectlake.llm.staging import free, stage

PLAN = f"group int, size long, cuts {CUTS}"


def even(total: int, shards: int) -> list[int]:
    """Capacities that add up to ``total`` and differ by at most one."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def transfers(old: dict[int, int], capacities: Sequence[int]) -> dict[tuple[int, int], int]:
    """Bytes from old to new shards, keeping as many as possible in place."""
    arcs = [("start", ("old", i), n, 0) for i, n in sorted(old.items())]
    pairs = [(i, j) for i in sorted(old) for j in range(len(capacities))]
    first = len(arcs)
    arcs += [(("old", i), ("new", j), old[i], int(i != j)) for i, j in pairs]
    arcs += [(("new", j), "end", n, 0) for j, n in enumerate(capacities)]
    flows, _ = min_cost_flow(arcs, "start", "end")
    return {pair: f for pair, f in zip(pairs, flows[first:], strict=False) if f}


def reshard(
    docs: DataFrame, old: str, size: str, shards: int, *, capacities: Sequence[int] | None = None,
    seed: int = 29, key: str = "doc_id",
) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 within a shard).

    ``old`` is the old shard (int; null counts as 0), ``size`` the bytes of a
    row (long, null: 0).  Shards are filled to ``capacities`` (near equal by
    default), up to a small row at each border of a block.
    Every row comes back, repeated ones too, with all columns; clashing ``shard`` and
    ``slot`` columns are replaced.  An empty table gives an empty result.
    ``docs`` is read once and written with its order.
    """
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    home, weight, order, into, salt = free("home", "weight", "order", "into", "salt", among=own)
    keyed = salted(docs.select(own), key, salt).select(
        *own,
        F.coalesce(F.col(old).cast("int"), F.lit(0)).alias(home),
        F.coalesce(F.col(size).cast("long"), F.lit(0)).alias(weight),
        dealt(seed, salt, key).alias(order),
    )
    keyed = stage(keyed, "reshard")
    sizes = {r[0]: r[1] for r in keyed.groupBy(home).agg(F.sum(weight)).collect()}
    room = list(capacities or even(sum(sizes.values()), shards))
    moved = transfers(sizes, room)
    cuts = []
    for i in sorted(sizes):
        at, blocks = 0, []
        for j in sorted(range(shards), key=lambda j, i=i: (j != i, j)):
            if n := moved.get((i, j), 0):
                blocks.append((str(j), at, at + n))
                at += n
        cuts.append((i, sizes[i], blocks))
    cut = docs.sparkSession.createDataFrame(cuts, PLAN)
    # Rows of no bytes in a range of no bytes fall into no block: they stay.
    shard = F.expr(f"cast(coalesce(try_element_at(`{into}`, 1), `{home}` % {shards}) as int)")
    placed = divide(keyed, home, order, key, weight, cut, 1, into).select(*own, order, shard.alias("shard"))
    return number(placed, "shard", order, key, "slot").drop(order)


def rewrite(placed: DataFrame, old: str, path: str) -> list[int]:
    """Write anew, under ``path/shard=N``, the shards that gained or lost rows; others keep their files.

    Shards that lost all their rows are removed after the others are written.
    ``placed`` must not read from ``path``.  The number of shards bounds what
    the driver sees.
    """
    changed = placed.filter(~F.col(old).eqNullSafe(F.col("shard"))).select(
        F.explode(F.array(F.col("shard"), F.col(old).cast("int"))).alias("shard")
    )
    touched = sorted(r[0] for r in changed.distinct().collect() if r[0] is not None)
    anew = placed.filter(F.col("shard").isin(touched))
    left = {r[0] for r in anew.select("shard").distinct().collect()}
    (
        anew.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(path)
    )
    # An overwrite by partition leaves alone what has no rows.
    spark = placed.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for shard in touched:
        if shard not in left:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"shard={shard}"), True)
    return touched
