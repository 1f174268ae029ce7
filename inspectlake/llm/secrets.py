"""Secret scan with a worklist of decoded layers.

A text is the first layer.  Percent escapes and Unicode escapes of a layer give
one decoded layer each; base64 tokens, and compressed data inside them, give a
layer for each token; compressed data, of any size, is unpacked and searched
window by window.  Layers are decoded until nothing new appears; a layer
met before is not taken up again, so cycles end.  Every layer is scanned with
the same three patterns, and what is found is mapped back to the characters of
the text it came from.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The kinds of finding in the order of their report, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}

PERCENT = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    rb"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}={0,2}")

#: Base64 broken into lines of the usual lengths.
WRAPPED = re.compile(
    rb"(?<![A-Za-z0-9+/_-])(?:(?:[A-Za-z0-9+/_-]{76}\r?\n)+(?:[A-Za-z0-9+/_-]{1,76}={0,2})?|(?:[A-Za-z0-9+/_-]{64}\r?\n)+(?:[A-Za-z0-9+/_-]{1,64}={0,2})?)"
)

#: Decompressed data goes through the scanner in windows of about so many
#: characters, which begin with the last characters of the one before.
WINDOW, OVERLAP = 1 << 20, 1 << 16
#: A window grows until it ends outside a run that may be decoded, at most to
#: this; base64 that is longer is decoded as it comes.
LONGEST = 16 << 20
PIECE = 1 << 18
_RUN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=%\\&#;{}-\r\n"
_SPACES = re.compile(" {65,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_\r\n-]*")
_BAD = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)

_HEXES = bytes(0x61 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
_BASE64S = bytes(0x61 if re.match(rb"[A-Za-z0-9+/_-]", bytes([c])) else 0x20 for c in range(256))
_KEYWORDS = (b"passw", b"secret", b"token", b"api")

FOUND = T.ArrayType(
    T.StructType()
    .add("kind", T.StringType())
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
    .add("layer", T.IntegerType())
)


def _points(text: str) -> bytes:
    """One byte a code point, so that places in bytes are places in the text."""
    return text.encode("latin-1", "replace")


def scan_layer(raw: bytes) -> list[tuple[str, int, int]]:
    """Findings (kind, start, end) of one layer, each kind leftmost and without overlap."""
    out = []
    lower = raw.lower()
    if any(word in lower for word in _KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(raw) if len(m[1]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(raw) if len(m[0]) >= LEAST["access"]]
    if b"a" * LEAST["hex"] in raw.translate(_HEXES):
        out += [("hex", *m.span()) for m in HEX.finditer(raw)]
    return out


class Layer:
    """A decoded text; character i comes from [starts[i], ends[i]) of the first one."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, depth: int, streamed: bool = False):
        self.text, self.starts, self.ends, self.depth, self.streamed = text, starts, ends, depth, streamed
        self.raw = _points(text)


def _runs(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match decoded in place, or None if none could be."""
    texts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.raw):
        units = decode(m[0])
        if units is None:
            continue
        a, b = m.span()
        texts.append(layer.text[at:a])
        starts.append(layer.starts[at:a])
        ends.append(layer.ends[at:a])
        place = a
        for char, width in units:
            texts.append(char)
            starts.append(layer.starts[place : place + 1])
            ends.append(layer.ends[place + width - 1 : place + width])
            place += width
        at = b
    if not texts:
        return None
    texts.append(layer.text[at:])
    starts.append(layer.starts[at:])
    ends.append(layer.ends[at:])
    return Layer("".join(texts), np.concatenate(starts), np.concatenate(ends), layer.depth + 1)


def _percent(run: bytes) -> list[tuple[str, int]]:
    decoded = binascii.unhexlify(run.replace(b"%", b"")).decode("utf-8", "surrogateescape")
    return [("\ufffd", 3) if "\udc80" <= c <= "\udcff" else (c, 3 * len(c.encode())) for c in decoded]


def _escape(run: bytes) -> list[tuple[str, int]] | None:
    if run.startswith(b"&#"):
        code = int(run[3:-1], 16) if run[2:3] in b"xX" else int(run[2:-1])
    elif run.startswith(b"\\u{"):
        code = int(run[3:-1], 16)
    elif run.startswith(b"\\u"):
        units = binascii.unhexlify(run.replace(b"\\u", b"")).decode("utf-16-be", "replace")
        wide = [(c, 12 if c > "\uffff" else 6) for c in units]
        return wide if sum(w for _, w in wide) == len(run) else None
    else:
        code = int(run[2:], 16)
    return [(chr(code), len(run))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class _Zlib:
    """gzip or zlib with the interface of the other decompressors."""

    def __init__(self):
        self.machine, self.needs_input = zlib.decompressobj(wbits=47), True

    def decompress(self, data: bytes, most: int) -> bytes:
        out = self.machine.decompress(self.machine.unconsumed_tail + data, most)
        self.needs_input = len(out) < most
        return out

    eof = property(lambda self: self.machine.eof)
    unused_data = property(lambda self: self.machine.unused_data)


def _machine(head: bytes):
    """The decompressor for data that begins with ``head``, or None."""
    if head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2]) % 31 == 0):
        return _Zlib()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[:6] == b"\xfd7zXZ\x00" else None


def _filled(data: bytes, pieces: Iterator[bytes]) -> bytes:
    """``data`` with so many pieces that its kind can be told."""
    while len(data) < 6 and (more := next(pieces, None)) is not None:
        data += more
    return data


def _members(data: bytes, pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Packed data, of any number of members, in pieces; damaged data as far as it goes."""
    while (machine := _machine(data)) is not None:
        while not machine.eof:
            try:
                out = machine.decompress(data, PIECE)
            except _BAD:
                return
            data = b""
            if out:
                yield out
            if not machine.eof and machine.needs_input and (data := next(pieces, None)) is None:
                return
        data = _filled(machine.unused_data, pieces)
    if data:
        yield data
    yield from pieces


def _unpacked(data: bytes, pieces: Iterator[bytes]) -> Iterator[bytes] | None:
    """Data in pieces, unpacked as often as it is packed; None if it is not."""
    data, met = _filled(data, pieces), set()
    packed = False
    while _machine(data) is not None and (mark := hashlib.blake2b(data).digest()) not in met:
        met.add(mark)
        inner = _members(data, pieces)
        if not (first := _filled(b"", inner)):
            return chain([data], pieces) if packed else None
        data, pieces, packed = first, inner, True
    return chain([data], pieces) if packed else None


def _windows(pieces: Iterator[bytes]) -> Iterator[str | Iterator[bytes]]:
    """Texts that together show all there is in a stream; base64 too long for one comes as a stream of its own."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    buffer, seen = "", 0
    for piece in pieces:
        buffer += decoder.decode(piece)
        if len(buffer) - seen < WINDOW:
            continue
        buffer = _SPACES.sub(" " * 64, buffer)
        cut = len(_points(buffer).rstrip(_RUN))
        if cut <= seen:
            if len(buffer) - seen < LONGEST:
                continue
            cut = len(buffer)
            at = len(buffer.rstrip(_RUN.decode().translate(_NO_ESCAPES)))
            if cut - at >= LONGEST // 2:
                rest = [""]
                yield buffer
                yield _open_token(buffer[at:], pieces, decoder, rest)
                buffer, seen = buffer[max(0, at - OVERLAP) : at] + rest[0], 0
                continue
        yield buffer[:cut]
        start = max(0, cut - OVERLAP)
        buffer, seen = buffer[start:], cut - start
    buffer += decoder.decode(b"", True)
    if len(buffer) > seen or not seen:
        yield buffer


_NO_ESCAPES = {ord(c): None for c in "=%\\&#;{}"}


def _open_token(text: str, pieces: Iterator[bytes], decoder, rest: list[str]) -> Iterator[bytes]:
    """The bytes of base64 that begins with ``text`` and goes on in ``pieces``; what follows it goes to ``rest``."""
    left = ""
    while True:
        end = _TOKEN.match(text).end()
        left += re.sub(r"[\r\n]", "", text[:end]).replace("-", "+").replace("_", "/")
        whole = len(left) // 4 * 4
        yield binascii.a2b_base64(left[:whole])
        left = left[whole:]
        if end < len(text) or (piece := next(pieces, None)) is None:
            break
        text = decoder.decode(piece)
    rest[0] = text[end:]
    if len(left) > 1:
        yield binascii.a2b_base64(left + "=" * (4 - len(left)))


def _readable(data: bytes) -> str | None:
    """Data as text, bad bytes replaced, or None if more than a tenth is no text."""
    text = data.decode("utf-8", "replace")
    odd = sum(c == "\ufffd" or (not c.isprintable() and c not in "\t\r\n") for c in text)
    return text if odd * 10 <= len(text) else None


def _token(layer: Layer, a: int, b: int) -> Iterator[Layer]:
    """Layers of the base64 in [a, b): one of its text, or the windows of what is packed in it."""
    core = re.sub(rb"[\r\n=]", b"", layer.raw[a:b]).replace(b"-", b"+").replace(b"_", b"/")
    if len(core) % 4 == 1:
        core = core[:-1]
    data = binascii.a2b_base64(core + b"=" * (-len(core) % 4))
    place = int(layer.starts[a:b].min()), int(layer.ends[a:b].max())
    if (stream := _unpacked(data, iter(()))) is not None:
        yield from _streamed(stream, place, layer.depth + 1)
    elif text := _readable(data):
        yield _placed(text, place, layer.depth + 1)


def _streamed(stream: Iterator[bytes], place: tuple[int, int], depth: int) -> Iterator[Layer]:
    for window in _windows(stream):
        if isinstance(window, str):
            if window:
                yield _placed(window, place, depth, True)
            continue
        first = _filled(b"", window)
        inner = _unpacked(first, window)
        yield from _streamed(chain([first], window) if inner is None else inner, place, depth + 1)
        for _ in window:  # to its end, so that what follows is known
            pass


def _placed(text: str, place: tuple[int, int], depth: int, streamed: bool = False) -> Layer:
    starts, ends = (np.broadcast_to(np.int64(p), len(text)) for p in place)
    return Layer(text, starts, ends, depth, streamed)


def _tokens(layer: Layer) -> Iterator[Layer]:
    """The layers of each base64 token that decodes to text, directly or through compression."""
    if b"a" * 16 not in layer.raw.translate(_BASE64S):
        return
    done = 0
    wrapped = [m.span() for m in WRAPPED.finditer(layer.raw)] if b"\n" in layer.raw else []
    for m in BASE64.finditer(layer.raw):
        if m.start() < done:
            continue
        while wrapped and wrapped[0][0] < m.start():
            wrapped.pop(0)
        if wrapped and wrapped[0][0] == m.start():
            a, b = wrapped.pop(0)
            b = a + len(layer.raw[a:b].rstrip(b"\r\n"))
            if b > m.end():
                for nested in _token(layer, a, b):
                    done = b
                    yield nested
                if done == b:
                    continue
        yield from _token(layer, *m.span())


def _escaped(layer: Layer) -> Iterator[Layer]:
    if b"%" in layer.raw and (out := _runs(layer, PERCENT, _percent)):
        yield out
    if (b"\\" in layer.raw or b"&#" in layer.raw) and (out := _runs(layer, ESCAPE, _escape)):
        yield out


def find(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, layer) of a whole text, by start, kind, end; layer 0 is the text itself.

    A finding of a deeper layer that covers the same characters as one of its
    kind from a layer before is not repeated.
    """
    if not text:
        return []
    plain = _points(text)
    found = {(kind, a, b): 0 for kind, a, b in scan_layer(plain)}
    if b"%" in plain or b"\\" in plain or b"&#" in plain or b"a" * 16 in plain.translate(_BASE64S):
        where = np.arange(len(text) + 1, dtype=np.int64)
        whole = Layer(text, where[:-1], where[1:], 0)
        _search(whole, found, {_mark(whole)})
    order = {kind: i for i, kind in enumerate(KINDS)}
    spans = [(kind, a, b, depth) for (kind, a, b), depth in found.items()]
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def _search(first: Layer, found: dict[tuple[str, int, int], int], met: set[bytes]) -> None:
    """Add what is found in a layer and in all layers below it.

    Windows of packed data are searched one after the other, so that only one
    of each token is held.
    """
    work = deque([first])
    while work:
        layer = work.popleft()
        if layer.depth:
            for kind, a, b in scan_layer(layer.raw):
                place = (kind, int(layer.starts[a:b].min()), int(layer.ends[a:b].max()))
                found[place] = min(layer.depth, found.get(place, layer.depth))
        for nested in chain(_escaped(layer), _tokens(layer)):
            if (mark := _mark(nested)) in met:
                continue
            met.add(mark)
            if nested.streamed:
                _search(nested, found, met)
            else:
                work.append(nested)


def _mark(layer: Layer) -> bytes:
    """Text and origin of a layer: the same text elsewhere is another finding, in the same place a cycle."""
    ends = f"{layer.starts[0]}:{layer.ends[-1]}:".encode() if len(layer.starts) else b""
    return hashlib.blake2b(ends + layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _text(value: bytes | None) -> str | None:
    return None if value is None else codecs.decode(value, "utf-8", "replace")


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``secrets``, an array of (kind, start, end, layer) in code points, end exclusive.

    Rows and the columns ``keep`` (all by default) stay; a clashing ``secrets``
    column is replaced.  A null or empty text has none.
    """
    own = [c for c in (keep if keep is not None else docs.columns) if c != "secrets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.int32())]))
        for batch in batches:
            rows = [
                [dict(zip(("kind", "start", "end", "layer"), s, strict=True)) for s in find(_text(t))]
                for t in batch.column(text).cast(pa.binary()).to_pylist()
            ]
            arrays = [*(batch.column(c) for c in own), pa.array(rows, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*own, "secrets"])

    schema = docs.select(*own).schema.add("secrets", FOUND)
    return docs.select(*dict.fromkeys([*own, text])).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every found span, of any layer, replaced by ``mark``; overlapping spans by one mark."""
    own = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [_redacted(_text(t), mark) for t in batch.column(text).cast(pa.binary()).to_pylist()]
            arrays = [pa.array(clean, batch.schema.field(c).type) if c == text else batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays(arrays, names=own)

    return docs.mapInArrow(run, docs.schema)


def _redacted(text: str | None, mark: str) -> str | None:
    out, at = [], 0
    for _, a, b, _ in find(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return text if not out else "".join(out) + text[at:]
