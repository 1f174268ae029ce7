"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Documents longer than a bin are cut into full pieces and a rest.  Pieces are
dealt by a seeded hash into groups of bounded expected size, repeated documents
and those without a key apart from each other; a group is packed
in one task, pieces in falling order of length.  Bins are kept by residual
room; each carries a bitmap of its sources and one of its duplicate clusters.
From the tightest residual that holds the piece, the successor search goes on
until a bin shares neither a source nor a cluster with it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectlake.llm.dealing import dealt, salted
from inspectlake.llm.staging import stage

#: Pieces expected in a group.
GROUP_PIECES = 2048
PACKED = "doc_id long, piece int, start long, length long, bin long, place int, residual long"
ARROW = pa.schema(
    [(n, pa.int32() if n in ("piece", "place") else pa.int64()) for n in (x.split()[0] for x in PACKED.split(", "))]
)


def best_fit(pieces: Iterable[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin of each (length, source, cluster), in the order given; null clusters never conflict."""
    bits: dict[object, int] = {}
    by_room: dict[int, dict[int, list[int]]] = {}
    rooms = 0  # bit r: some bin has room r
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in pieces:
        s = 1 << bits.setdefault(("source", source), len(bits))
        c = 0 if cluster is None else 1 << bits.setdefault(("cluster", cluster), len(bits))
        room, found, above = length, None, rooms >> length
        while above:
            step = (above & -above).bit_length() - 1
            room += step
            found = next(
                (b for mask, bins in by_room[room].items() if not mask & s for b in bins if not clusters[b] & c), None
            )
            if found is not None:
                break
            above >>= step + 1
            room += 1
        if found is None:
            found, room = len(sources), capacity
            sources.append(0)
            clusters.append(0)
        else:
            level = by_room[room]
            level[sources[found]].remove(found)
            if not level[sources[found]]:
                del level[sources[found]]
            if not level:
                del by_room[room]
                rooms ^= 1 << room
        sources[found] |= s
        clusters[found] |= c
        by_room.setdefault(room - length, {}).setdefault(sources[found], []).append(found)
        rooms |= 1 << (room - length)
        out.append(found)
    return out


def pack(
    docs: DataFrame, size: str, source: str, cluster: str, *, capacity: int = 2048, seed: int = 43, key: str = "doc_id"
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, bin, place in the bin, residual room of the bin.

    ``size`` null or below 0 counts as 0; such a document is one piece of
    length 0.  A null source counts as one source, a null cluster as none.
    Repeated rows are packed as often as they occur.  Only the three columns
    and the key are read.  An empty table gives no bins.
    """
    kept = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        F.col(source).cast("string").alias("source"),
        F.col(cluster).cast("string").alias("cluster"),
    )
    pieces = salted(kept, "doc_id", "salt").withColumn(
        "piece", F.explode(F.expr(f"sequence(0, cast(greatest(0, (size - 1) div {capacity}) as int))"))
    ).selectExpr(
        "doc_id", "source", "cluster", "salt", "piece", f"cast(piece as long) * {capacity} as start",
        f"least(size - cast(piece as long) * {capacity}, {capacity}) as length",
    )
    pieces = stage(pieces, "pieces")
    groups = max(1, -(-pieces.count() // GROUP_PIECES))

    def one_group(group: pa.Table) -> pa.Table:
        def falling(row: dict):
            return (-row["length"], *((row[c] is None, row[c]) for c in ("doc_id", "piece", "cluster", "source")))

        rows = sorted(group.to_pylist(), key=falling)
        bins = best_fit(((r["length"], r["source"], r["cluster"]) for r in rows), capacity)
        filled, count = Counter(), Counter()
        for r, b in zip(rows, bins, strict=True):
            r["place"] = count[b]
            count[b] += 1
            filled[b] += r["length"]
        out = [
            r | {"bin": (r["part"] << 32) + b, "residual": capacity - filled[b]}
            for r, b in zip(rows, bins, strict=True)
        ]
        return pa.Table.from_pylist(out, schema=ARROW)

    part = F.pmod(dealt(seed, "salt", "doc_id", "piece"), F.lit(groups)).alias("part")
    return pieces.select("*", part).drop("salt").groupBy("part").applyInArrow(one_group, PACKED)
