"""Hashed word shingles of whole texts, vectorized over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes worked on at a time; longer texts are taken in pieces cut between words.
SLICE = 1 << 20

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_STEP = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.held = np.uint64(base), np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            grown = np.full(max(n, 2 * len(self.held)), self.base, dtype=np.uint64)
            grown[0] = 1
            self.held = np.multiply.accumulate(grown)
        return self.held[:n]


_FORWARD, _BACKWARD = _Powers(_BASE), _Powers(pow(_BASE, -1, 2**64))


def _pieces(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > SLICE:
        window = np.frombuffer(raw, dtype=np.uint8, count=SLICE, offset=at)
        gaps = np.flatnonzero(_SPACE[window])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:  # one word beyond the slice: go on to its end
            later = [p for s in b" \t\n\r\x0b\x0c" if (p := raw.find(bytes([s]), at + SLICE)) >= 0]
            end = min(later, default=len(raw) - 1) + 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _hash_words(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word: a polynomial in random byte values, then mixed."""
    codes = np.frombuffer(joined, dtype=np.uint8)
    gap = _SPACE[codes]
    edge = np.flatnonzero(np.diff(gap.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[codes] * _FORWARD.upto(len(codes)), out=total[1:])
    # Brought to a common power, so that the place of a word does not count.
    hashes = (total[ends] - total[starts]) * _BACKWARD.upto(len(codes) + 1)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text, in order."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    batch: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if not batch:
            return
        hashes, starts = _hash_words(b" ".join(piece for _, piece in batch))
        limits = np.cumsum([len(piece) + 1 for _, piece in batch])[:-1]
        for (owner, _), own in zip(batch, np.split(hashes, np.searchsorted(starts, limits)), strict=True):
            out[owner].append(own)
        batch.clear()

    for owner, text in enumerate(texts):
        for piece in _pieces(text):
            if size + len(piece) > SLICE:
                flush()
                size = 0
            batch.append((owner, piece))
            size += len(piece) + 1
    flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text.

    A text of fewer words is one shingle as a whole; one without words has none.
    A-Z count as a-z.  Words lie between ASCII white space.
    """
    out = []
    for words in word_hashes([t.lower() for t in texts]):
        n = min(k, len(words))
        if n == 0:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        rows = len(words) - n + 1
        total = np.full(rows, n, dtype=np.uint64)
        for j in range(n):
            total += words[j : j + rows] * _STEP[j]
        out.append(np.unique(mix(total)))
    return out
