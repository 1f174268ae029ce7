"""Mixing overlapping sources to target weights by minimum-cost flow.

A document may belong to several sources.  Documents are aggregated by
membership pattern; words flow from patterns to the quotas of their sources,
where the n-th repetition of a pattern costs n - 1 a word, so a cheapest flow
repeats as little as it can.  The flow of a pattern is then cut along a seeded
order of its documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectlake.llm.cutting import CUTS, divide
from inspectlake.llm.dealing import dealt, salted
from inspectlake.llm.flow import min_cost_flow
from inspectlake.llm.staging import free, stage

#: Membership patterns the driver plans for; more raise an error.
MAX_PATTERNS = 100_000

PLAN = f"group string, size long, cuts {CUTS}"
QUOTAS = "source string, source_size long, target double"


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Shares of ``budget`` by weight; a share above ``most`` times its size
    stops there and the excess is shared anew among the others."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), budget
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in sorted(open_)}
        over = [i for i in share if share[i] > most * sizes[i]]
        if not over:
            for i in share:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def mix(
    docs: DataFrame,
    member: str,
    size: str,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 17,
    key: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """Documents with ``mix_sources`` (the source of each copy taken), and the quotas.

    ``member`` is an array of source names (null is a name; a null or empty
    array belongs nowhere and is never taken), ``size`` a long (null: 0).
    Sources in code point order, null last, get ``weights`` in rotation.
    Documents without words are never taken.  Every input row comes back, also
    repeated ones; clashing column names are replaced.  An empty table gives an
    empty mix.  ``docs`` is read once and written with its order.
    """
    own = [c for c in docs.columns if c.lower() != "mix_sources"]
    pattern, words, order, salt = free("pattern", "words", "order", "salt", among=own)
    keyed = salted(docs.select(own), key, salt).select(
        *own,
        F.expr(f"to_json(array_sort(array_distinct(coalesce(`{member}`, array()))))").alias(pattern),
        F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias(words),
        dealt(seed, salt, key).alias(order),
    )
    keyed = stage(keyed, "order")
    totals = keyed.groupBy(pattern).agg(
        F.sum(words).alias("n"), F.expr(f"first(array_sort(array_distinct(coalesce(`{member}`, array()))))").alias("of")
    )
    rows = totals.limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    rows = sorted(rows, key=lambda r: r[pattern])
    quotas, plan = _plan(
        [(r[pattern], r["n"], list(r["of"])) for r in rows], weights, share, repeats, docs.sparkSession
    )
    cut = divide(keyed, pattern, order, key, words, plan, repeats, "mix_sources")
    taken = F.when(F.col(words) > 0, F.col("mix_sources")).otherwise(F.array().cast("array<string>"))
    return cut.select(*own, taken.alias("mix_sources")), quotas


def _plan(patterns, weights, share, repeats, spark):
    names = sorted({s for _, _, of in patterns for s in of}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n, of in patterns if s in of) for s in names]
    turn = [weights[i % len(weights)] for i in range(len(names))]
    aims = targets(sizes, turn, share * sum(n for _, n, of in patterns if of), repeats)
    arcs, routes = [], []
    for i, (_, n, of) in enumerate(patterns):
        arcs += [("start", ("pattern", i), n, level) for level in range(repeats)]
        for s in of:
            routes.append((len(arcs), i, s))
            arcs.append((("pattern", i), ("source", s), repeats * n, 0))
    arcs += [(("source", s), "end", round(aim), 0) for s, aim in zip(names, aims, strict=True)]
    flows, _ = min_cost_flow(arcs, "start", "end")
    cuts: dict[int, list] = {i: [] for i in range(len(patterns))}
    at = [0] * len(patterns)
    for arc, i, s in routes:
        if flows[arc]:
            cuts[i].append((s, at[i], at[i] + flows[arc]))
            at[i] += flows[arc]
    plan = spark.createDataFrame([(p, n, cuts[i]) for i, (p, n, _) in enumerate(patterns)], PLAN)
    return spark.createDataFrame(list(zip(names, sizes, aims, strict=True)), QUOTAS), plan


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it was taken."""
    return mixed.withColumn("mix_sources", F.explode("mix_sources")).drop("mix_sources")


def mix_table(docs: DataFrame, size: str, **options) -> tuple[DataFrame, DataFrame]:
    """``mix`` over a table with one ``source`` a document.

    Only numbers and sources go through the mix; the documents, numbered in a
    written table, are joined with what it decides, once.
    """
    key = options.get("key", "doc_id")
    member, row = free("member", "row", among=docs.columns)
    held = stage(docs.drop("mix_sources").withColumn(row, F.monotonically_increasing_id()), "mix")
    narrow = held.select(row, key, F.col(size).alias("size"), F.array("source").alias(member))
    mixed, quotas = mix(narrow, member, "size", **options)
    decided = mixed.select(F.col(row).alias(f"{row}_of"), "mix_sources")
    return held.join(decided, F.col(row) == F.col(f"{row}_of")).drop(row, f"{row}_of"), quotas
