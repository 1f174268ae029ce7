"""Near-duplicate documents by SetSketch registers.

A document is its set of word shingles.  Register i holds the exponentially
spaced, truncated minimum of the i-th hash over the set: sketches merge by
maximum, and two registers are equal with a probability close to the
similarity.  Bands of registers give candidates; a likelihood over all
registers, given both set sizes, sorts out most; the rest is confirmed on the
full sets.

Equal sets are one class from the start.  In a bucket of candidates links are
sought first from the smallest document to the others.  Buckets that still hold
several components then meet in blocks, where likely pairs of different
components are confirmed, the likeliest first, until they are joined or found
apart.  So a bucket of any number of copies costs about one test a document, no
pairs leave a task but links, and no link between two components goes untested.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectlake.llm.components import components
from inspectlake.llm.shingles import mix, shingle_sets
from inspectlake.llm.staging import stage

#: Sketch parameters: base of the register values, rate, largest value.
BASE = 1.02
RATE = 20.0
LIMIT = 2**16 - 1
#: Registers in a band: unrelated documents then rarely meet, also among 10**10.
ROWS = 5
#: Share of pairs at the very threshold that no band may bring together.
MISSED = 1e-6
#: Standard deviations by which an estimate may fall short before a pair is dropped unverified.
SLACK = 5.0
#: Documents of a bucket compared in one task; larger buckets go out in pairs of blocks.
BLOCK = 512

SKETCHED = "row_id long, n_shingles long, set_hash binary, registers binary, bands array<long>"


def register_match(x: np.ndarray) -> np.ndarray:
    """p_b of the sketch: chance that a register is larger on the side that has a share x of its own."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def bands_needed(threshold: float) -> int:
    """Bands so that a pair at the threshold meets in one but for ``MISSED``."""
    equal = 1 - 2 * float(register_match(np.array((1 - threshold) / 2)))
    return math.ceil(math.log(MISSED) / math.log1p(-(equal**ROWS)))


class Sketcher:
    def __init__(self, bands: int):
        rng = np.random.default_rng(11)
        self.m = bands * ROWS
        self.factor = rng.integers(1, 2**64, self.m, dtype=np.uint64) | np.uint64(1)
        self.shift = rng.integers(0, 2**64, self.m, dtype=np.uint64)
        self.salt = rng.integers(1, 2**64, (bands, ROWS), dtype=np.uint64) | np.uint64(1)
        self.band = mix(np.arange(bands, dtype=np.uint64))

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(self.m, 2**64 - 1, dtype=np.uint64)
        for at in range(0, len(shingles), 1024):
            hashed = shingles[at : at + 1024, None] * self.factor
            hashed += self.shift
            np.minimum(least, hashed.min(axis=0), out=least)
        spaced = -np.log1p(-(least.astype(np.float64) + 1.0) / (2.0**64 + 2.0**12)) / RATE
        return np.clip(np.floor(1 - np.log(spaced) / math.log(BASE)), 0, LIMIT).astype(np.uint16)

    def bands(self, registers: np.ndarray) -> np.ndarray:
        parts = registers.reshape(self.salt.shape).astype(np.uint64) + np.uint64(1)
        return mix((mix(parts) * self.salt).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)


_GRID = np.linspace(0.0, 1.0, 201)


def likelihood_estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair of register rows, given the set sizes."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    grid = _GRID[None, :] * np.minimum(u / v, v / u)
    p, q = register_match(np.clip(u - v * grid, 0, 1)), register_match(np.clip(v - u * grid, 0, 1))
    tiny = 1e-12
    score = above * np.log(p + tiny) + below * np.log(q + tiny) + equal * np.log(np.maximum(1 - p - q, tiny))
    return np.take_along_axis(grid, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def least_estimate(threshold: float, registers: int) -> float:
    return threshold - SLACK * math.sqrt(threshold * (1 - threshold) / registers)


def _raw(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def sketch(docs: DataFrame, key: str, text: str, k: int, bands: int) -> DataFrame:
    """(row_id, n_shingles, set_hash, registers, bands) of every row; without shingles the last three are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, hashes, registers, keys = [], [], [], []
                for own in shingle_sets(_raw(part.column(1)), k):
                    sizes.append(len(own))
                    if not len(own):
                        for column in (hashes, registers, keys):
                            column.append(None)
                        continue
                    values = sketcher.registers(own)
                    hashes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    registers.append(values.tobytes())
                    keys.append(sketcher.bands(values))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()),
                        pa.array(registers, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["row_id", "n_shingles", "set_hash", "registers", "bands"],
                )

    return docs.select(F.col(key).cast("long").alias("row_id"), text).mapInArrow(run, SKETCHED)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among candidate pairs: estimated by likelihood, confirmed on the full sets."""
    side = lambda s: texts.select(*(F.col(c).alias(f"{c}_{s}") for c in texts.columns))
    full = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    full = full.select("a", "b", *(f"{c}_{s}" for s in "ab" for c in ("registers", "n_shingles", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ra, rb = (
                    np.stack([np.frombuffer(x, dtype=np.uint16) for x in part.column(f"registers_{s}").to_pylist()])
                    for s in "ab"
                )
                na, nb = (part.column(f"n_shingles_{s}").to_numpy() for s in "ab")
                likely = likelihood_estimate(ra, rb, na, nb) >= least_estimate(percent / 100, ra.shape[1])
                part = part.filter(pa.array(likely))
                sets = shingle_sets(_raw(part.column("text_a")) + _raw(part.column("text_b")), k)
                n = part.num_rows
                linked = [_alike(x, y, percent) for x, y in zip(sets[:n], sets[n:], strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return full.mapInArrow(run, "a long, b long")


def _between(members: DataFrame, texts: DataFrame, k: int, percent: int, bands: int) -> DataFrame:
    """Links (a, b) between different components that meet in a bucket."""
    sizes = members.groupBy(F.col("key").alias("size_key")).agg(
        F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("top")
    )
    open_ = sizes.filter("size > 2 and low < top").selectExpr("size_key", f"cast(ceil(size / {BLOCK}) as int) as blocks")
    mine = members.join(open_, F.col("key") == F.col("size_key")).select(
        "key", "id", "root", "lead", "blocks", F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("own")
    )
    # A block meets every block: the pair (i, j) is one task, i <= j.
    meet = mine.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", "id", "root", "lead", "own",
        F.expr("least(own, other)").alias("i"), F.expr("greatest(own, other)").alias("j"),
    )
    side = texts.withColumnRenamed("id", "text_id")
    full = meet.join(side, F.col("id") == F.col("text_id")).drop("text_id")

    def run(table: pa.Table) -> pa.Table:
        ids, roots, lead, own, n = (table[c].to_numpy() for c in ("id", "root", "lead", "own", "n_shingles"))
        registers = np.stack([np.frombuffer(x, dtype=np.uint16) for x in table["registers"].to_pylist()])
        sketcher = Sketcher(bands)
        keys = np.stack([sketcher.bands(r) for r in registers])
        key, same = table["key"][0].as_py(), table["i"][0].as_py() == table["j"][0].as_py()
        enough = least_estimate(percent / 100, registers.shape[1])
        found: list[tuple[float, int, int]] = []
        for x in np.flatnonzero(ids != lead[0]).tolist():
            right = np.flatnonzero((roots != roots[x]) & (ids > ids[x]) & (ids != lead[0]) & (same | (own != own[x])))
            # A pair is looked at in the first bucket that it shares; with the smallest of that it has been tested.
            shared = keys[right] == keys[x]
            right = right[keys[x][shared.argmax(axis=1)] == key]
            if len(right):
                pair = np.broadcast_to(registers[x], (len(right), registers.shape[1]))
                score = likelihood_estimate(pair, registers[right], np.full(len(right), n[x]), n[right])
                likely = score >= enough
                found += [(-s, x, y) for s, y in zip(score[likely].tolist(), right[likely].tolist(), strict=True)]
        needed = sorted({x for _, *pair in found for x in pair})
        raw = _raw(table["text"].combine_chunks().take(pa.array(needed, pa.int64())))
        sets = dict(zip(needed, shingle_sets(raw, k), strict=True))
        head: dict[int, int] = {}

        def top(r: int) -> int:
            while r in head:
                r = head[r]
            return r

        links = []
        for _, x, y in sorted(found):
            p, q = top(int(roots[x])), top(int(roots[y]))
            if p != q and _alike(sets[x], sets[y], percent):
                head[p] = q
                links.append((ids[x], ids[y]))
        a, b = (np.array([pair[i] for pair in links], dtype=np.int64) for i in (0, 1))
        return pa.table({"a": a, "b": b})

    return full.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _roots(members: DataFrame, joined: DataFrame) -> DataFrame:
    side = joined.select(F.col("id").alias("node"), "root")
    return members.join(side, F.col("id") == F.col("node"), "left").select(
        *members.columns, F.coalesce("root", "id").alias("root")
    )


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Rows whose sets have 100 * intersection >= ``percent`` * union are linked;
    component_id is the smallest key reachable.  A row without words or text
    has no shingles and is its own component.  Rows with equal keys are taken
    as copies of one document.  Rows without a key take part under their class,
    are never kept, and keep a null component_id if no member has a key.
    An empty table gives no rows.
    """
    bands = bands_needed(percent / 100)
    rows = stage(sketch(docs, key, text, k, bands), "sketches")
    # Written, so that a join with a class of very many copies is one of two plain inputs, which Spark can split.
    classes = stage(
        rows.filter("set_hash is not null").groupBy(F.col("set_hash").alias("class")).agg(F.min("row_id").alias("id")),
        "classes",
    )
    firsts = rows.join(classes.filter("id is not null"), (F.col("set_hash") == F.col("class")) & (F.col("row_id") == F.col("id")))
    exploded = firsts.select("id", F.explode("bands").alias("key")).distinct()
    buckets = exploded.groupBy(F.col("key").alias("bucket")).agg(F.min("id").alias("lead"), F.max("id").alias("last"))
    members = stage(
        exploded.join(buckets.filter("lead < last"), F.col("key") == F.col("bucket")).select("key", "id", "lead"), "buckets"
    )
    texts = stage(
        members.select("id")
        .distinct()
        .join(firsts.select(F.col("id").alias("first_id"), "n_shingles", "registers").dropDuplicates(["first_id"]), F.col("id") == F.col("first_id"))
        .join(docs.select(F.col(key).cast("long").alias("doc_key"), F.col(text).alias("text")).filter("doc_key is not null"), F.col("id") == F.col("doc_key"))
        .select("id", "n_shingles", "registers", "text")
        .dropDuplicates(["id"]),
        "texts",
    )
    star = members.filter("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = stage(_verified(star, texts, k, percent), "links")
    joined = components(links)
    more = stage(_between(_roots(members, joined), texts, k, percent, bands), "links")
    if not more.isEmpty():
        joined = components(links.union(more))
    found = rows.select("row_id", "n_shingles", "set_hash").join(classes, F.col("set_hash") == F.col("class"), "left")
    side = joined.select(F.col("id").alias("node"), "root")
    component = F.coalesce("root", "id", F.when(F.col("set_hash").isNull(), F.col("row_id")))
    return found.join(side, F.col("id") == F.col("node"), "left").select(
        F.col("row_id").alias("doc_id"), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("row_id") == component, F.lit(False)).alias("kept"),
    )
