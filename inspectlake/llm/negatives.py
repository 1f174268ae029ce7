"""Hard negatives by a secondary sort.

Scores travel under packed keys (anchor, descending score, positives first, id)
in one shuffle that also sorts within its partitions.  An iterator over the
sorted rows opens a window at each positive, hands every following negative to
the open windows and closes a window once it is full or its floor is passed, so
it holds a few windows and never an anchor's rows.

Before that shuffle, blocks of vectors stream past blocks of anchors and keep
what can still matter: first the nearest rows of the anchor's label, then, with
the positives known, the first rows of each window.  A row that an anchor's
windows cannot reach is never sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inspectlake.llm.dealing import dealt, salted
from inspectlake.llm.staging import stage

VECTOR_BLOCK = 8192
ANCHOR_BLOCK = 2048
#: Streams of vector blocks that pass a block of anchors side by side.
LANES = 64
#: Anchors whose scores are held at a time.
AT_ONCE = 256
SEED = 12
LONGEST_LONG = 2**63 - 1

PACKED = "block long, ids array<long>, labels array<long>, width int, components array<long>"


def _packed(rows: DataFrame, size: int, salt: str | None = None) -> tuple[DataFrame, int]:
    """Rows (vec_id, label, v) as one row per block of about ``size``, and the number of blocks; vectors are padded by 0."""
    blocks = max(1, -(-rows.count() // size))
    own = dealt(SEED, salt, "vec_id") if salt else F.xxhash64(F.lit(SEED), "vec_id")

    def pack(table: pa.Table) -> pa.Table:
        vectors = table["v"].combine_chunks()
        lengths = np.asarray(vectors.value_lengths())
        width = int(lengths.max())
        matrix = np.zeros((len(lengths), width), dtype=np.int64)
        matrix[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        cells = [table["block"][:1].combine_chunks(), *([table[c].to_numpy()] for c in ("vec_id", "label")), [width], [matrix.ravel()]]
        types = [pa.int64(), *[pa.list_(pa.int64())] * 2, pa.int32(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=["block", "ids", "labels", "width", "components"])

    dealt_rows = rows.select(F.pmod(own, F.lit(blocks)).cast("long").alias("block"), "vec_id", F.col("label").cast("long").alias("label"), "v")
    return dealt_rows.groupBy("block").applyInArrow(pack, PACKED), blocks


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held at the ends of a long; missing components are 0."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = lambda x: float(np.abs(x.astype(float)).max(initial=0.0))
    bound = most(a) * most(b) * width
    if bound < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if bound < 2**62:
        return a @ b.T
    wide = b.T.astype(object)
    rows = [[max(-LONGEST_LONG, min(LONGEST_LONG, int(s))) for s in row.astype(object) @ wide] for row in a]
    return np.array(rows, dtype=np.int64)


class _Best:
    """The first ``most`` rows by descending score, then id, of all that were offered."""

    def __init__(self, most: int):
        self.most = most
        self.scores = self.ids = self.rows = np.zeros(0, dtype=np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(self.scores) == self.most:
            near = scores >= self.scores[-1]
            scores, ids, rows = scores[near], ids[near], rows[near]
        if not len(scores):
            return
        if len(scores) > 4 * self.most:
            least = np.partition(scores, -self.most)[-self.most]
            near = scores >= least
            scores, ids, rows = scores[near], ids[near], rows[near]
        scores, ids, rows = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        first = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids, self.rows = scores[first], ids[first], rows[first]


def least_hard(positive: int, percent: int) -> int:
    """The smallest integer n with percent * positive <= 100 * n."""
    return -((-positive * percent) // 100)


class _Meeting:
    """A block of anchors that blocks of vectors pass; ``positives`` has each anchor's positive scores, or is None."""

    def __init__(self, ids, labels, matrix, positives, most: int, percent: int):
        self.ids, self.labels, self.matrix, self.passed = ids, labels, matrix, 0
        # Of the two ends of a window: scores up to the positive's, not under the floor.
        self.windows = [[(None, None)]] * len(ids) if positives is None else [[(p, least_hard(p, percent)) for p in own] for own in positives]
        self.near = positives is None
        self.best = [[_Best(most) for _ in own] for own in self.windows]

    def meet(self, ids, labels, matrix) -> None:
        rows = self.passed + np.arange(len(ids))
        self.passed += len(ids)
        for first in range(0, len(self.ids), AT_ONCE):
            scores = products(self.matrix[first : first + AT_ONCE], matrix)
            for a, own in enumerate(scores, first):
                fits = (labels == self.labels[a]) == self.near
                fits &= ids != self.ids[a]
                for (high, low), best in zip(self.windows[a], self.best[a], strict=True):
                    at = np.flatnonzero(fits if high is None else fits & (own <= high) & (own >= low))
                    best.offer(own[at], ids[at], rows[at])

    def found(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for anchor, windows in zip(self.ids, self.best, strict=True):
            rows = np.concatenate([w.rows for w in windows]) if windows else np.zeros(0, dtype=np.int64)
            _, once = np.unique(rows, return_index=True)
            if len(once):
                yield anchor, np.concatenate([w.ids for w in windows])[once], np.concatenate([w.scores for w in windows])[once]


FOUND = "anchor_id long, vec_id long, score long"


def _met(vectors: DataFrame, blocks: int, anchors: DataFrame, turns: int, most: int, percent: int) -> DataFrame:
    """What blocks of vectors hold for each anchor, by one stream for each block of anchors and lane."""
    lanes = min(LANES, blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    passing = vectors.select(every(turns).alias("turn"), F.expr(f"block % {lanes}").alias("lane"), F.lit(1).alias("kind"), "*", F.expr("cast(null as array<array<long>>)").alias("positives"))
    standing = anchors.select(F.col("block").alias("turn"), every(lanes).alias("lane"), F.lit(0).alias("kind"), "*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c, i=i, batch=batch: batch.column(c)[i]
                ids, labels = (cell(c).values.to_numpy() for c in ("ids", "labels"))
                matrix = cell("components").values.to_numpy().reshape(len(ids), -1) if cell("width").as_py() else np.zeros((len(ids), 0), np.int64)
                if cell("kind").as_py() == 0:
                    yield from _told(now)
                    now = _Meeting(ids, labels, matrix, cell("positives").as_py(), most, percent)
                elif now:
                    now.meet(ids, labels, matrix)
        yield from _told(now)

    both = standing.unionByName(passing).repartition("turn", "lane").sortWithinPartitions("turn", "lane", "kind", "block")
    return both.drop("turn", "lane", "block").mapInArrow(run, FOUND)


def _told(meeting: _Meeting | None) -> Iterator[pa.RecordBatch]:
    if meeting:
        for anchor, ids, scores in meeting.found():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), anchor)), pa.array(ids), pa.array(scores)], names=["anchor_id", "vec_id", "score"])


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(items: DataFrame, anchors: str, *, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``items`` has vec_id, label and v, an array of integers; ``anchors`` is an
    SQL condition on vec_id.  An anchor's positives are the first rows of its
    label by descending inner product, then id; for each, the first rows of
    other labels whose score is at most the positive's and at least ``percent``
    of it.  Rows with a null in these columns or in the vector take no part.
    Vectors of different lengths meet as if padded by 0.  A repeated vec_id is
    so many rows but one anchor, the one of the least label and vector, and no
    row of its id is its partner.  Scores beyond a long stay at its ends.  An
    anchor without positives, or a positive without such rows, gives no rows.
    """
    fine = items.filter("vec_id is not null and label is not null and v is not null and forall(v, x -> x is not null)")
    held = stage(salted(fine.select("vec_id", "label", "v"), "vec_id", "salt"), "items")
    packed, blocks = _packed(held, VECTOR_BLOCK, "salt")
    vectors = stage(packed, "blocks")
    asked = stage(
        held.filter(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("least")).select("vec_id", "least.label", "least.v"),
        "anchors",
    )
    standing, turns = _packed(asked, ANCHOR_BLOCK)
    standing = stage(standing, "standing")
    none = F.expr("cast(null as array<array<long>>)").alias("positives")
    near = _met(vectors, blocks, standing.select("*", none), turns, positives, percent)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = stage(near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives).drop("n"), "positives")

    # Positive scores of each anchor, in the order of its block.
    own = near.groupBy("anchor_id").agg(F.collect_list("score").alias("scores"))
    placed = standing.select("block", F.posexplode("ids").alias("place", "anchor_id")).join(own, "anchor_id", "left")
    lists = placed.groupBy("block").agg(F.expr("transform(array_sort(collect_list(struct(place, coalesce(scores, array()) as s))), x -> x.s)").alias("positives"))
    hard = _met(vectors, blocks, standing.join(lists, "block"), turns, negatives, percent)

    key = [F.col("anchor_id"), F.expr("-score").alias("descending"), "kind", "vec_id"]
    rows = near.withColumn("kind", F.lit(0)).unionByName(hard.withColumn("kind", F.lit(1)))
    keyed = rows.select(*key).repartition("anchor_id").sortWithinPartitions("anchor_id", "descending", "kind", "vec_id")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, open_windows = None, []
        for batch in batches:
            out = []
            for at, descending, kind, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != anchor:
                    anchor, open_windows = at, []
                if kind == 0:
                    open_windows.append([vec, -descending, least_hard(-descending, percent), 0])
                    continue
                open_windows = [w for w in open_windows if w[3] < negatives and w[2] <= -descending]
                for w in open_windows:
                    w[3] += 1
                    out.append((anchor, w[0], w[3], vec, w[1], -descending))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return keyed.mapInArrow(windows, MINED)
