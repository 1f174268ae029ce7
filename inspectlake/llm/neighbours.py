"""Approximate nearest neighbours by multi-index hashing of rotated binary codes.

Vectors become bits by the signs of learned rotations (iterative quantization
on a bounded sample).  A code is split into substrings and each is indexed.
Codes within Hamming radius r of a query agree with it to within r // m in one
of the m substrings at least (and to within one less in the later ones), so
probing those values retrieves every code within the radius; these are ranked
by the inner product of the vectors themselves.

Vectors and queries meet in blocks of bounded size, one task each, with
substrings somewhat longer than the logarithm of a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectlake.llm.dealing import dealt, salted
from inspectlake.llm.staging import stage

#: Vectors the rotations and the radius are fitted on (expected number).
SAMPLE = 20_000
BITS = 128
TURNS = 30
#: Share of the sample's true neighbours that the radius has to cover.
COVERED = 0.97
SAMPLE_QUERIES = 512
VECTOR_BLOCK = 8192
QUERY_BLOCK = 2048
#: Bits by which a radius grows while a block has not given enough neighbours.
WIDER = 8

#: Substrings of a code, and the changes by at most so many bits of one.
PART_BITS = 16
_VALUES = np.arange(1 << PART_BITS, dtype=np.uint16)
_BY_ONES = _VALUES[np.argsort(np.bitwise_count(_VALUES), kind="stable")]
_UP_TO = np.cumsum(np.bincount(np.bitwise_count(_VALUES)))
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: finite, not zero, of the commonest length (ties: the shorter).

    Rows without a key take no part.
    """
    v = f"`{vector}`"
    fine = vectors.filter(
        f"`{key}` is not null and {v} is not null and size({v}) > 0 "
        f"and forall({v}, x -> x is not null and abs(double(x)) < double('infinity')) and exists({v}, x -> x != 0)"
    ).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    common = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return fine.filter(F.size("v") == (common[0]["d"] if common else 0))


class Codes:
    """Learned rotations of vectors that were lifted to equal length, so that angles rank inner products."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int):
        self.longest = longest or 1.0
        lifted = self.lift(sample)
        width = lifted.shape[1]
        rng = np.random.default_rng(seed)
        self.rotations = []
        while len(self.rotations) * width < BITS:
            turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
            for _ in range(TURNS):
                u, _, w = np.linalg.svd(np.where(lifted @ turn >= 0, 1.0, -1.0).T @ lifted)
                turn = (u @ w).T
            self.rotations.append(turn)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1, keepdims=True)))
        return np.hstack([scaled, rest])

    def _bits(self, lifted: np.ndarray) -> np.ndarray:
        signs = np.hstack([lifted @ turn >= 0 for turn in self.rotations])[:, :BITS]
        return np.packbits(signs, axis=1)

    def of_vectors(self, vectors: np.ndarray) -> np.ndarray:
        return self._bits(self.lift(vectors))

    def of_queries(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return self._bits(np.hstack([unit, np.zeros((len(unit), 1))]))


def hamming(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(code ^ codes).sum(axis=-1, dtype=np.int64)


def learn(sample: np.ndarray, longest: float, seed: int, k: int) -> tuple[Codes, int]:
    """Rotations, and the radius that covers ``COVERED`` of the sample's own k nearest."""
    codes = Codes(sample, longest, seed)
    queries = sample[np.random.default_rng(seed).permutation(len(sample))[:SAMPLE_QUERIES]]
    if len(sample) < 2:
        return codes, BITS
    scores = queries @ sample.T
    near = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
    asked, stored = codes.of_queries(queries), codes.of_vectors(sample)
    distances = np.concatenate([hamming(a, stored[n]) for a, n in zip(asked, near, strict=True)])
    return codes, int(np.quantile(distances, COVERED, method="higher"))


class Index:
    """Inverted lists of the substrings of codes: rows by value, lists behind one another."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes.view(np.uint32).T)
        parts = np.ascontiguousarray(codes.view(np.uint16).T)
        self.rows = np.argsort(parts, axis=1, kind="stable")
        self.values = np.take_along_axis(parts, self.rows, axis=1)
        self.start = [np.concatenate([[0], np.cumsum(np.bincount(part, minlength=len(_VALUES)))]) for part in parts]

    def _listed(self, j: int, part: np.uint16, reach: int) -> np.ndarray:
        """Rows in the lists of substring ``j`` whose value is ``part`` but for ``reach`` bits."""
        near = _UP_TO[min(reach, PART_BITS)] if reach >= 0 else 0
        if near >= self.rows.shape[1]:
            # More values than rows: read off which lists are meant along the rows.
            return self.rows[j][np.bitwise_count(self.values[j] ^ part) <= reach]
        keys = (part ^ _BY_ONES[:near]).astype(np.intp)
        first = self.start[j][keys]
        count = self.start[j][keys + 1] - first
        skip = np.repeat(first - (np.cumsum(count) - count), count)
        return self.rows[j][skip + np.arange(len(skip))]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within ``radius`` of ``code``."""
        each, extra = divmod(radius, len(self.rows))
        hit = np.zeros(self.rows.shape[1], dtype=bool)
        for j, part in enumerate(code.view(np.uint16)):
            hit[self._listed(j, part, each if j <= extra else each - 1)] = True
        rows = np.flatnonzero(hit)
        apart = sum(np.bitwise_count(word[rows] ^ own) for word, own in zip(self.words, code.view(np.uint32), strict=True))
        return rows[apart <= radius]


def search(vectors: DataFrame, key: str, vector: str, queries: str, *, k: int = 20, seed: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest by inner product.

    ``queries`` is an SQL condition on the key (``vec_id``); a query is no
    candidate of its own.  Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do those of another length than the
    commonest.  Ties go to the smaller key.  A block that finds fewer than k
    within the radius widens it, so only too few vectors give fewer rows.  A
    key that occurs repeatedly is so many candidates, but one query (its
    smallest vector).  An empty table gives no rows.
    """
    held = stage(salted(usable(vectors, key, vector), "vec_id", "salt"), "vectors")
    count, longest = held.agg(
        F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    ).first()
    spread = dealt(seed, "salt", "vec_id") / F.lit(2.0**64) + F.lit(0.5)
    sample = held.filter(spread < SAMPLE / max(1, count)).select("v").toPandas()["v"]
    matrix = np.stack(sample.to_numpy()) if len(sample) else np.zeros((1, 1))
    codes, radius = learn(matrix, longest or 1.0, seed, k)
    shared = held.sparkSession.sparkContext.broadcast((codes, radius))

    asked = held.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-count // VECTOR_BLOCK))
    turns = max(1, -(-asked.count() // QUERY_BLOCK))
    own = F.pmod(dealt(seed, "salt", "vec_id"), F.lit(blocks))
    turn = F.expr(f"pmod(xxhash64({seed + 1}, vec_id), {turns})")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    meet = held.select(own.alias("block"), every(turns).alias("turn"), F.lit(False).alias("asks"), "vec_id", "v").union(
        asked.select(every(blocks).alias("block"), turn.alias("turn"), F.lit(True).alias("asks"), "vec_id", "v")
    )

    def one_block(rows: pa.Table) -> pa.Table:
        codes, radius = shared.value
        asks = rows["asks"].to_numpy(zero_copy_only=False).astype(bool)
        ids = rows["vec_id"].to_numpy()
        values = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        return _nearest(ids[~asks], values[~asks], ids[asks], values[asks], codes, radius, k)

    best = meet.groupBy("block", "turn").applyInArrow(one_block, FOUND)
    ranked = best.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(ids, values, query_ids, queries, codes: Codes, radius: int, k: int) -> pa.Table:
    out: tuple[list, list, list] = ([], [], [])
    if len(ids) and len(query_ids):
        index = Index(codes.of_vectors(values))
        room = np.empty_like(values)
        for q, vector, code in zip(query_ids, queries, codes.of_queries(queries), strict=True):
            others = len(ids) - int((ids == q).sum())
            reach = radius
            while True:
                rows = index.within(code, reach)
                rows = rows[ids[rows] != q]
                if len(rows) >= min(k, others):
                    break
                reach += WIDER
            # Row by row, so that equal vectors have equal scores.
            found = np.take(values, rows, axis=0, out=room[: len(rows)], mode="clip")
            scores = np.einsum("ij,j->i", found, vector)
            if len(rows) > k:
                best = scores >= np.partition(scores, -k)[-k]
                rows, scores = rows[best], scores[best]
            top = np.lexsort((ids[rows], -scores))[:k]
            out[0].append(np.full(len(top), q))
            out[1].append(ids[rows][top])
            out[2].append(scores[top])
    arrays = [np.concatenate(x) if x else np.zeros(0) for x in out]
    return pa.table(
        [pa.array(arrays[0].astype("int64")), pa.array(arrays[1].astype("int64")), pa.array(arrays[2].astype("float64"))],
        names=["query_id", "vec_id", "score"],
    )
