"""Language-model scoring by online logistic context mixing.

A text is UTF-8 bytes and one end mark.  Each symbol is spelled by the bits of a
prefix code of the two bytes before it, so that likely symbols take few
decisions.  For every bit, several predictors look up how often it was 0 or 1 in
the training texts after their hashed context (the last 3 or 5 bytes, or the
word so far).  Their log odds are added with weights that a gate selects by the
longest context that is known; the weights follow every coded bit by gradient
steps, and a table of observed odds, adapted alike, refines the sum.  Bits cost
-log2 of the final probability.  Weights and odds start afresh at each window of
a text, contexts do not, so windows of any texts are mixed side by side.

Counts of contexts have a fixed number of slots and are merged from all
training texts.  Word counts have no bound and stay a table: a bounded number
of frequent words goes to every task, all others are joined.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inspectlake.llm.staging import free, stage

END = 256
SYMBOLS = 257
#: Bytes of the contexts; 0 is the word so far.  A later known context selects the gate.
CONTEXTS = (3, 5, 0)
WORD_REACH = 24
#: Bytes before a window that its contexts may need.
REACH = 32
SLOT_BITS = 21
#: Counters sent together, and training bytes after which a task sends its counters.
CHUNK = 1 << 16
SENT_BYTES = 1 << 28
SALTS = 16
WINDOW = 512
#: Windows mixed side by side, those spelled at a time, and steps prepared at a time.
LANES = 4096
FEW = 128
STEPS = 16
#: Log odds are held in 1/16.
SCALE = 16.0
PRIOR = 0.15
RATE = np.float32(0.01)
START_WEIGHT = 0.35
#: The refining table by ranges of the expected bit: what the mix lacks there.
ODDS_STEPS = 32
HALF = np.float32(ODDS_STEPS / 2)
ODDS_RATE = np.float32(0.005)
LEAST = 1e-5
#: First weights: levels of log odds on either side of 0 and the width of one, steps of the fit, and the pull to START_WEIGHT.
LEVELS = 16
LEVEL = 8
ROUNDS = 8
RIDGE = 5.0
#: Words of at most so many bytes that every task holds with their counts.
FREQUENT = 100_000
WORD_BYTES = 64
#: Words that are sent on together, and rows that are scored so.
REST = 50_000
ROWS = 2048

#: Pairs of bytes with a code of their own.
TREES = 1024
#: Symbols rarer than this share are spelled as if they had it.
RAREST = 1 << 14

_MIX = np.uint32(0x9E3779B1)
_STEP = np.uint32(0x01000193)


def huffman(weights: list[int]) -> list[list[tuple[int, int]]]:
    """(inner node, bit) on the way to each leaf; nodes are numbered from the root, so that first ones lie close together."""
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    children, fresh = {}, itertools.count(len(weights))
    while len(heap) > 1:
        (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
        children[node := next(fresh)] = (left, right)
        heapq.heappush(heap, (a + b, node))
    paths: dict[int, list[tuple[int, int]]] = {heap[0][1]: []}
    level, number = [heap[0][1]], itertools.count()
    while level:
        for node in (inner := [x for x in level if x in children]):
            own = next(number)
            for bit, child in enumerate(children[node]):
                paths[child] = [*paths[node], (own, bit)]
        level = [child for node in inner for child in children[node]]
    return [paths[i] for i in range(len(weights))]


class Code:
    """Prefix codes of the symbols: one for each frequent pair of preceding bytes, a plain one for the rest.

    The code of a pair spells the symbols met there more than once; any other
    is an escape and its plain code.  Every symbol has a plain code, none a very
    long one.
    """

    def __init__(self, plain: dict[int, int], pairs: dict[int, dict[int, int]]):
        floor = sum(plain.values()) // RAREST + 1
        spelled = [[(n, b) for n, b in path] for path in huffman([plain.get(s, 0) + floor for s in range(SYMBOLS)])]
        self.tree_of = np.zeros(1 << 16, dtype=np.int32)
        paths = list(spelled)
        for tree, (pair, counts) in enumerate(sorted(pairs.items()), 1):
            self.tree_of[pair] = tree
            own = [s for s, n in sorted(counts.items()) if n > 1]
            found = huffman([*(counts[s] for s in own), len(counts) - len(own) + 1])
            base = tree * int(_MIX) % 2**32
            placed = [[((base + n) % 2**32, b) for n, b in path] for path in found]
            known = dict(zip(own, placed, strict=False))
            paths += [known.get(s) or placed[-1] + spelled[s] for s in range(SYMBOLS)]
        lengths = [len(p) for p in paths]
        self.lengths = np.array(lengths, dtype=np.int32)
        self.first = np.cumsum([0, *lengths[:-1]], dtype=np.int32)
        self.nodes = np.array([n for p in paths for n, _ in p], dtype=np.uint32)
        self.bits = np.array([b for p in paths for _, b in p], dtype=np.uint8)

    @functools.cached_property
    def steps(self) -> np.ndarray:
        """Node and bit in one number, as counters are numbered; made where it is used, so that it is not sent."""
        return self.nodes << np.uint32(1) | self.bits


def windows(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """Each window behind the ``REACH`` bytes before it (spaces before the text), and whether the text ends there."""
    text = b" " * REACH + text
    last = max(0, (len(text) - REACH - 1) // WINDOW)
    for i in range(last + 1):
        yield text[i * WINDOW : (i + 1) * WINDOW + REACH], i == last


class Bits:
    """Bits of several windows in one run: node and bit, and the hashed contexts of their symbols."""

    def __init__(self, parts: list[tuple[bytes, bool]], code: Code):
        marked = [text + b"\0" if ends else text for text, ends in parts]
        sizes = np.array([len(m) for m in marked], dtype=np.int32)
        symbols = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint16)
        edges = np.cumsum(sizes, dtype=np.int32)
        symbols[edges[[ends for _, ends in parts]] - 1] = END
        coded = np.ones(len(symbols), dtype=bool)
        coded[(edges - sizes)[:, None] + np.arange(REACH)] = False
        coded = np.flatnonzero(coded)
        self.contexts = [_scattered(c.take(coded)) for c in _contexts(symbols)]
        pair = symbols.astype(np.int32)
        pair[2:] = (pair[:-2] & 255) << 8 | pair[1:-1] & 255
        spelled = code.tree_of.take(pair.take(coded))
        spelled *= SYMBOLS
        spelled += symbols.take(coded)
        lengths = code.lengths.take(spelled)
        ends = np.cumsum(lengths, dtype=np.int64)
        # The symbol of each bit; every symbol has one at least.
        self.symbol = np.zeros(ends[-1], dtype=np.intp)
        self.symbol[ends[:-1]] = 1
        np.cumsum(self.symbol, out=self.symbol)
        at = np.take(code.first.take(spelled) - (ends - lengths), self.symbol, mode="clip")
        at += np.arange(len(at))
        self.step = np.take(code.steps, at, mode="clip")
        self.of_window = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes - REACH)])])

    def slots(self, context: int) -> np.ndarray:
        """Slots of a context's nodes lie behind one another, the first nodes of its symbols next to each other."""
        return self.counters(context) >> 1

    def counters(self, context: int) -> np.ndarray:
        """Each bit's own counter in its slot: twice the slot plus the bit."""
        counters = np.take(self.contexts[context] << np.uint32(1), self.symbol, mode="clip")
        counters += self.step
        counters &= np.uint32((2 << SLOT_BITS) - 1)
        return counters.astype(np.intp)

    @property
    def bit(self) -> np.ndarray:
        return (self.step & np.uint32(1)).astype(np.uint8)


def _scattered(hashes: np.ndarray) -> np.ndarray:
    hashes ^= hashes >> np.uint32(15)
    hashes *= _STEP
    hashes ^= hashes >> np.uint32(13)
    hashes *= _MIX
    hashes ^= hashes >> np.uint32(16)
    return hashes


_SPACE = np.zeros(SYMBOLS, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32, END]] = True


def _contexts(symbols: np.ndarray) -> list[np.ndarray]:
    """Hash of each context before each symbol."""
    value = symbols.astype(np.uint32) + np.uint32(1)
    last, made = np.zeros(len(value), dtype=np.uint32), {}
    for back in range(1, max(CONTEXTS) + 1):
        last[back:] += value[:-back]
        last *= _MIX
        made[back] = last.copy() if back in CONTEXTS else None
    if 0 in CONTEXTS:
        # The word so far as a difference of running sums, scaled back to its start.
        index = np.arange(len(value), dtype=np.int32)
        start = np.zeros_like(index)
        start[1:] = np.maximum.accumulate(np.where(_SPACE.take(symbols), index + 1, 0))[:-1]
        start = np.maximum(start, index - WORD_REACH)
        powers, back = _powers(1 << len(value).bit_length())
        sums = np.zeros(len(value) + 1, dtype=np.uint32)
        np.cumsum(value * powers[: len(value)], dtype=np.uint32, out=sums[1:])
        made[0] = (sums[:-1] - sums.take(start)) * back.take(start)
    return [made[c] for c in CONTEXTS]


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint32(pow(int(_MIX), -1, 2**32))
    return tuple(np.cumprod(np.full(n, x, dtype=np.uint32), dtype=np.uint32) for x in (_MIX, inverse))


class Lanes:
    """Bits of windows side by side, one bit of each at a step; longer windows come first."""

    def __init__(self, of_window: np.ndarray, rows: np.ndarray):
        self.order = np.argsort(-of_window, kind="stable")
        lengths = of_window[self.order]
        self.starts = (np.cumsum(of_window) - of_window)[self.order]
        # Windows still coding at each step.
        steps = int(lengths.max(initial=0))
        self.alive = np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()
        self.rows = rows.view(np.uint64).ravel()

    def mix(self, weights: np.ndarray) -> np.ndarray:
        """Bits that each window costs, in the order of the windows.

        Bits are -1 and 1 and predicted by their expectation, tanh of half the log odds.
        """
        n, width = len(CONTEXTS), len(self.order)
        lane, spent = np.arange(width) * (ODDS_STEPS + 1), np.zeros(width)
        learned, seen = np.zeros((n, width), dtype=np.float32), np.zeros((ODDS_STEPS + 1) * width, dtype=np.float32)
        for low in range(0, len(self.alive), STEPS):
            alive = self.alive[low : low + STEPS]
            # Next steps of a window lie together; those behind its end are read, but not used.
            steps = np.arange(low, low + len(alive))
            rows = self.rows.take(self.starts[: alive[0], None] + steps, mode="clip").T.ravel().view(np.int8).reshape(-1, ROW)
            xs = np.ascontiguousarray(rows[:, :n].T, dtype=np.float32)
            xs *= np.float32(0.5 / SCALE)
            fixed = np.einsum("ij,ij->j", weights.take(rows[:, GATE], axis=1), xs)
            bits = rows[:, BIT] * np.float32(2) - np.float32(1)
            steps = [(step * alive[0], step * alive[0] + on) for step, on in enumerate(alive)]
            for a, b in steps:
                x, bit, more = xs[:, a:b], bits[a:b], learned[:, : b - a]
                first = np.einsum("ij,ij->j", more, x)
                first += fixed[a:b]
                np.tanh(first, out=first)
                more += x * ((bit - first) * RATE)
                near = (first * HALF + HALF).astype(np.intp)
                near += lane[: b - a]
                off = seen[near]
                first += off
                fixed[a:b] = first
                off += (bit - first) * ODDS_RATE
                seen[near] = off
            cost = np.log2(np.clip(bits * fixed + 1, 2 * LEAST, 2 - 2 * LEAST))
            for a, b in steps:
                spent[: b - a] += 1 - cost[a:b]
        out = np.empty(width)
        out[self.order] = spent
        return out


#: A bit's row: log odds by context, then gate and bit, in 8 bytes.
ROW, GATE, BIT = 8, 6, 7


def rows_of(bits: Bits, odds_of) -> np.ndarray:
    rows = np.zeros((len(bits.bit), ROW), dtype=np.int8)
    gate = np.zeros(len(rows), dtype=np.int8)
    for c in range(len(CONTEXTS)):
        rows[:, c] = own = odds_of(c)
        np.maximum(gate, (own != 0).view(np.int8) * np.int8(c + 1), out=gate)
    rows[:, GATE], rows[:, BIT] = gate, bits.bit
    return rows


def mixed_bits(parts: list[tuple[bytes, bool]], code: Code, tables: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Bits of each window under the model."""
    lengths, rows = [], []
    for few in itertools.batched(parts, FEW):
        bits = Bits(list(few), code)
        rows.append(rows_of(bits, lambda c, bits=bits: np.take(tables[c], bits.slots(c), mode="clip")))
        lengths.append(bits.of_window)
    lanes = Lanes(np.concatenate(lengths), np.concatenate(rows))
    rows.clear()
    return lanes.mix(weights)


#: Cells of a tally: gates by levels of each context by bits.
CELLS = (len(CONTEXTS) + 1) * (2 * LEVELS + 1) ** len(CONTEXTS) * 2
#: What a context tells of a bit: a level, or nothing; cells of that, by context and bit.
KINDS = 2 * LEVELS + 2
TOLD = KINDS ** len(CONTEXTS) * 2


def tally_odds(parts: list[tuple[bytes, bool]], code: Code, counts: np.ndarray) -> np.ndarray:
    """How many bits of the windows lie in each cell: gate, level of each context's log odds, bit.

    A bit is left out of the counts (contexts by slots by two) it is predicted with.
    """
    return cells_of(tally_told(Bits(parts, code), told_without(counts)))


def told_without(counts: np.ndarray) -> np.ndarray:
    """By context, slot and bit: what is told of such a bit by the other bits counted there."""
    levels = np.rint(_odds_table() / np.float32(LEVEL)).astype(np.int8) + np.int8(LEVELS)
    kinds = np.where(_odds_table() == 0, KINDS - 1, levels).astype(np.uint8)
    told = np.empty(counts.shape, dtype=np.uint8)
    for own, pairs in zip(told, counts.reshape(len(counts), -1, 2), strict=True):
        zeros, ones = (np.minimum(pairs[:, bit].astype(np.int64), 256) for bit in range(2))
        for bit in range(2):
            left = (np.clip(n - (b == bit), 0, 255) for b, n in enumerate((zeros, ones)))
            own[bit::2] = kinds[tuple(left)[::-1]]
    return told


def tally_told(bits: Bits, told: np.ndarray) -> np.ndarray:
    """How many bits there are of each combination of what the contexts tell, and of each value."""
    key = np.zeros(len(bits.step), dtype=np.int32)
    for c, own in enumerate(told):
        key *= KINDS
        key += np.take(own, bits.counters(c), mode="clip")
    key *= 2
    key += bits.bit
    return np.bincount(key, minlength=TOLD)


def cells_of(tally: np.ndarray) -> np.ndarray:
    """The tally by gate, levels and bit: a context that tells nothing has level 0."""
    *kinds, bit = np.unravel_index(np.arange(TOLD), (*[KINDS] * len(CONTEXTS), 2))
    gate = np.zeros(TOLD, dtype=np.intp)
    for c, kind in enumerate(kinds):
        gate[kind < KINDS - 1] = c + 1
        kind[kind == KINDS - 1] = LEVELS
    cells = np.zeros(CELLS, dtype=np.int64)
    shape = (len(CONTEXTS) + 1, *[2 * LEVELS + 1] * len(CONTEXTS), 2)
    np.add.at(cells, np.ravel_multi_index((gate, *kinds, bit), shape), tally)
    return cells


@functools.lru_cache(maxsize=1)
def _odds_table() -> np.ndarray:
    """Log odds by count of ones and of zeros, up to 255."""
    ones, zeros = np.divmod(np.arange(1 << 16), 256)
    return log_odds(np.stack([zeros, ones], axis=1)).reshape(256, 256)


def tallied(texts: DataFrame, code: Code, counts: np.ndarray) -> np.ndarray:
    """The cells of all windows of the column ``text``, summed by Spark; of fixed size, whatever the corpus."""
    held = texts.sparkSession.sparkContext.broadcast((code, told_without(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, told = held.value
        tally = np.zeros(TOLD, dtype=np.int64)
        for batch in _slices(batches):
            for lot in _lots(batch.column("text").cast(pa.binary()).to_pylist(), 4 * FEW):
                tally += tally_told(Bits([part for _, part in lot], code), told)
        cells = cells_of(tally)
        met = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(cells[met], pa.int64())], names=["cell", "n"])

    cells = np.zeros(CELLS, dtype=np.int64)
    found = texts.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells[found["cell"].to_numpy()] = found["n"].to_numpy()
    return cells


def fit_weights(parts: list[tuple[bytes, bool]], code: Code, counts: np.ndarray) -> np.ndarray:
    """First weights from windows at hand."""
    return weights_of(tally_odds(parts, code, counts) if parts else np.zeros(CELLS, dtype=np.int64))


def weights_of(cells: np.ndarray) -> np.ndarray:
    """Weights (context by gate) that every window starts with, by logistic regression on the tallied bits."""
    n = len(CONTEXTS)
    weights = np.full((n, n + 1), START_WEIGHT, dtype=np.float32)
    for gate, own in enumerate(cells.reshape(n + 1, -1, 2)):
        met = np.flatnonzero(own.any(axis=1))
        levels = np.stack(np.unravel_index(met, (2 * LEVELS + 1,) * n), axis=1)
        x, (zeros, ones), w = (levels - LEVELS) * (LEVEL / SCALE), own[met].T.astype(float), weights[:, gate].astype(float)
        for _ in range(ROUNDS):
            p = _squash(x @ w)
            slope = x.T @ (ones - (zeros + ones) * p) + RIDGE * (START_WEIGHT - w)
            w = w + np.linalg.solve(x.T @ (x * ((zeros + ones) * p * (1 - p))[:, None]) + RIDGE * np.eye(n), slope)
        weights[:, gate] = w
    return weights


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of pairs of counts (no counts: 0) in 1/16, as signed bytes."""
    counts = np.maximum(counts.astype(np.int64), 0)
    return np.rint(SCALE * np.log((counts[:, 1] + PRIOR) / (counts[:, 0] + PRIOR))).clip(-127, 127).astype(np.int8)


def count_words(texts: DataFrame) -> DataFrame:
    """(kind, word, n) of the column ``text``.

    Counts of words (kind w) and of symbols behind their pair of bytes (s, four
    bytes).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols: Counter[int] = Counter()
        for batch in _slices(batches):
            column = batch.column("text").fill_null("")
            found = split_words(column)[0].value_counts()
            yield _counted("w", found.field(0).cast(pa.binary()), found.field(1))
            yield _counted("w", pa.array([b""], pa.binary()), pa.array([len(column)], pa.int64()))
            for some in itertools.batched(column.cast(pa.binary()).to_pylist(), 4 * FEW):
                for keys, times in _triples(some):
                    symbols.update(dict(zip(keys.tolist(), times.tolist(), strict=True)))
        yield _counted("s", pa.array([k.to_bytes(4) for k in symbols], pa.binary()), pa.array(symbols.values(), pa.int64()))

    return texts.mapInArrow(run, "kind string, word binary, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def _counted(kind: str, keys: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), keys, counts.cast(pa.int64())], names=["kind", "word", "n"])


def _triples(texts: tuple[bytes, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbols behind their pair of bytes (pair << 9 | symbol) with counts; spaces stand before a text."""
    sizes = np.array([len(t) + 3 for t in texts])
    symbols = np.frombuffer(b"".join(b"  " + t + b"\0" for t in texts), dtype=np.uint8).astype(np.int32)
    ends = np.cumsum(sizes)
    keys = (symbols[:-2] << 17) | (symbols[1:-1] << 9) | symbols[2:]
    keys[ends - 3] += END
    own = np.ones(len(keys), dtype=bool)
    own[ends[:-1] - 2] = own[ends[:-1] - 1] = False
    keys = keys[own]
    for at in range(0, len(keys), 1 << 20):
        yield np.unique(keys[at : at + (1 << 20)], return_counts=True)


def fit_code(counts: DataFrame) -> Code:
    """Codes from all symbols: of at most ``TREES`` pairs, so of bounded size."""
    key = F.expr("cast(conv(hex(word), 16, 10) as long)")
    symbols = counts.filter("kind = 's'").select(key.alias("key"), "n").select(F.expr("key >> 9").alias("pair"), F.expr("cast(key & 511 as int)").alias("symbol"), "n")
    plain = {r[0]: r[1] for r in symbols.groupBy("symbol").agg(F.sum("n")).collect()}
    often = symbols.groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(TREES).select("pair")
    pairs: dict[int, dict[int, int]] = {}
    for r in symbols.join(often, "pair").collect():
        pairs.setdefault(r["pair"], {})[r["symbol"]] = r["n"]
    return Code(plain, pairs)


def add_counts(counts: np.ndarray, bits: Bits) -> None:
    for c, own in enumerate(counts):
        np.add.at(own, bits.counters(c), np.uint32(1))


SENT = "context int, chunk int, salt int, counters binary"


def count_contexts(texts: DataFrame, code: Code) -> DataFrame:
    """(context, chunk, salt, counters): merged counts of zeros and ones by slot, packed by chunks."""
    held = texts.sparkSession.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        counts = np.zeros((len(CONTEXTS), 2 << SLOT_BITS), dtype=np.uint32)
        size = 0
        for batch in _slices(batches):
            for lot in _lots(batch.column("text").cast(pa.binary()).to_pylist(), FEW):
                add_counts(counts, Bits([part for _, part in lot], held.value))
                size += len(lot) * WINDOW
                if size > SENT_BYTES:
                    yield from _sent(counts, salt)
                    counts[:], size = 0, 0
        yield from _sent(counts, salt)

    parts = texts.mapInArrow(run, SENT)
    return _summed(_summed(parts, "context", "chunk", "salt"), "context", "chunk")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, in lower case, and the number of the text of each."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), pc.list_parent_indices(split).filter(full).to_numpy()


def _lots(texts: list[bytes | None], n: int) -> Iterator[tuple[tuple[int, tuple[bytes, bool]], ...]]:
    """Windows with the number of their text, n at a time."""
    every = ((i, part) for i, text in enumerate(texts) for part in windows(text or b""))
    return itertools.batched(every, n)


def _sent(counts: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    for c, own in enumerate(counts):
        chunks = own.reshape(-1, CHUNK)
        met = np.flatnonzero(chunks.any(axis=1)).tolist()
        yield _chunks([(c, k, salt, chunks[k]) for k in met])


def _chunks(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    packed = [pa.compress(counters.astype(np.int64).tobytes(), "zstd", asbytes=True) for *_, counters in rows]
    columns = [[r[i] for r in rows] for i in range(3)]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(packed, pa.binary())], names=["context", "chunk", "salt", "counters"])


def _counters(packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, CHUNK * 8, "zstd", asbytes=True), dtype=np.int64)


def _summed(parts: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, counters added as the rows of the key stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for row in batch.to_pylist():
                own = [row[k] for k in keys]
                if own != key:
                    if key:
                        yield _chunks([(key[0], key[1], (key + [0])[2], total)])
                    key, total = own, np.zeros(CHUNK, dtype=np.int64)
                total += _counters(row["counters"])
        if key:
            yield _chunks([(key[0], key[1], (key + [0])[2], total)])

    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, SENT)


def collected(chunks: DataFrame) -> np.ndarray:
    """Counters (context by slots by two), the two of a slot halved together until they fit a byte: a few MB, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = []
            for packed in batch.column("counters").to_pylist():
                counts = _counters(packed).reshape(-1, 2)
                halvings = np.maximum(0, np.frexp(counts.max(axis=1).astype(float))[1] - 8)
                small.append(pa.compress((counts >> halvings[:, None]).astype(np.uint8).tobytes(), "zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([batch.column("context"), batch.column("chunk"), pa.array(small, pa.binary())], names=["context", "chunk", "small"])

    made = np.zeros((len(CONTEXTS), 2 << SLOT_BITS), dtype=np.uint8)
    for row in chunks.mapInArrow(run, "context int, chunk int, small binary").collect():
        made[row["context"]][row["chunk"] * CHUNK :][:CHUNK] = np.frombuffer(pa.decompress(row["small"], CHUNK, "zstd", asbytes=True), dtype=np.uint8)
    return made


SCORES = "n_bytes long, n_tokens long, n_known long, base_score double, bits double"


def score(docs: DataFrame, learn: str, keep: list[str], *, text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with n_bytes, n_tokens, n_known, train_tokens, base_score, bits and bits_per_byte.

    The model learns from the rows for which ``learn`` (SQL; null: not) holds.
    ``bits`` is what the context mix takes for the text and its end; base_score
    is the sum of log10((c + 1) / (N + V + 1)) over lower-cased words and the
    end, of c in N training words of V kinds, and n_known the words with c > 0.
    A null text counts as empty: its end is its only word, and it has no bits
    per byte.  Repeated rows are learned from and scored each on its own.  With
    nothing to learn from all bits start at even odds.  An empty table gives no
    rows.  Other columns are ignored; of ``keep``, clashing ones are replaced.
    """
    learned = docs.filter(learn).select(F.col(text).alias("text"))
    counts = stage(count_words(learned), "words")
    code = fit_code(counts)
    seen = collected(stage(count_contexts(learned, code), "contexts"))
    weights = weights_of(tallied(learned, code, seen))
    odds = [log_odds(c.reshape(-1, 2)) for c in seen]
    met = counts.filter("kind = 'w'")
    total, kinds, ends = met.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.expr("coalesce(sum(n) filter (where word = X''), 0)")).first()
    space = math.log10(total + kinds + 1)
    short = met.filter(F.octet_length("word").between(1, WORD_BYTES))
    frequent = short.orderBy(F.desc("n"), "word").limit(FREQUENT).select(F.col("word").cast("string").alias("word"), "n").toArrow()
    known = frequent["word"].combine_chunks(), np.log10(frequent["n"].to_numpy() + 1.0) - space
    held = docs.sparkSession.sparkContext.broadcast((code, odds, weights, *known))

    new = T.StructType.fromDDL(SCORES)
    taken = {*(f.name for f in new), "train_tokens", "bits_per_byte"}
    own = [c for c in keep if c.lower() not in taken]
    row, rest, raw = free("row", "rest", "raw", among=own)
    given = docs.select(*own, F.col(text).cast("string").alias(raw))
    nullable = [T.StructField(f.name, f.dataType) for f in given.select(*own).schema]
    schema = T.StructType([*nullable, *new]).add(row, "long").add(rest, T.ArrayType(T.BinaryType()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, odds, weights, frequent, logs = held.value
        first = TaskContext.get().partitionId() << 33
        for batch in _slices(batches):
            n = batch.num_rows
            ids = first + np.arange(n)
            first += n
            raws = batch.column(raw).cast(pa.binary()).to_pylist()
            bits = np.zeros(n)
            for lot in _lots(raws, LANES):
                np.add.at(bits, [i for i, _ in lot], mixed_bits([part for _, part in lot], code, odds, weights))
            words, of = split_words(batch.column(raw))
            place = pc.fill_null(pc.index_in(words, value_set=frequent), -1).to_numpy()
            met = place >= 0
            scores = [
                [len(t or b"") for t in raws],
                np.bincount(of, minlength=n) + 1,
                np.bincount(of[met], minlength=n) + int(ends > 0),
                np.bincount(of[met], logs[place[met]], minlength=n) + (math.log10(ends + 1) - space),
                bits,
            ]
            columns = [batch.column(c) for c in own]
            columns += [pa.array(c, arrow.field(f.name).type) for c, f in zip(scores, new, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids), pa.nulls(n, arrow.field(rest).type)], schema=arrow)
            # Other words: lists of one text each, of bounded length.
            others, of = words.filter(pa.array(~met)).cast(pa.binary()), of[~met]
            within = np.arange(len(of)) - np.searchsorted(of, of)
            edges = np.flatnonzero(within % REST == 0)
            lists = pa.ListArray.from_arrays(pa.array([*edges, len(of)], pa.int32()), others).cast(arrow.field(rest).type)
            blank = [pa.nulls(len(edges), f.type) for f in arrow][:-2]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(ids[of[edges]]), lists], schema=arrow)

    scored = stage(given.mapInArrow(run, schema), "scored")
    unseen = scored.select(F.col(row).alias("of"), F.explode(rest).alias("word"))
    others = (
        unseen.join(met.select("word", "n"), "word", "left")
        .groupBy("of")
        .agg(
            F.sum(F.expr(f"log10(coalesce(n, 0) + 1) - {space!r}D")).alias("of_base"),
            F.count("n").alias("of_known"),
        )
    )
    found = scored.filter("n_tokens is not null").join(others, F.col(row) == F.col("of"), "left")
    return found.select(
        *own, "n_bytes", "n_tokens", F.expr("n_known + coalesce(of_known, 0L)").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), F.expr("base_score + coalesce(of_base, 0D)").alias("base_score"),
        "bits", F.expr("if(n_bytes = 0, null, bits / n_bytes)").alias("bits_per_byte"),
    )
