"""Secret scans through nested encodings.

A text is the first layer of a worklist. Each layer is searched for secrets and unwrapped: percent escapes and Unicode
escapes of the whole layer, runs of base64, and compressed bytes inside either. What comes out is a layer of its own, until
there is no new one. A layer that was seen with the same places in the text isn't taken again, which ends cycles. Every
character of a layer knows the part of the original text that it came from, so all spans are spans of the text.

Rows are independent: one pass, nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in order and their patterns. A run of at least 16 or 14 + 4 characters is found where a shorter one would be dropped.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
NAMES = re.compile(rb"passw|secret|token|api_?key", re.IGNORECASE)

ESCAPED = re.compile(r"""[^\s"'<>&;,=]*(?:%[0-9A-Fa-f]{2}[^\s"'<>&;,=%]*)+""")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"""\\u\{([0-9A-Fa-f]{1,6})\}|\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|((?:\\x[0-9A-Fa-f]{2})+)|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|\\([\\"'/nrt])""")
PLAIN_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}
#: The least secret has 16 bytes, 22 characters of base64; compressed bytes can be shorter.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{11,}")
ALPHABETS = (re.compile(r"[A-Za-z0-9+/]{11,}"), re.compile(r"[A-Za-z0-9_-]{11,}"), re.compile(r"[A-Za-z0-9]{11,}"))
LEAST_RUN = 22
CONTROL = re.compile(r"[\x00-\x08\x0E-\x1F\x7F]")

#: Characters of the layers of a text together; what would pass it stays closed and is counted. Whole texts don't count.
LIMIT = 1 << 25


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    secret: str
    layers: str


class Layer(NamedTuple):
    """A text, and by character (or for all of them) the start and end of its part of the original text."""

    text: str
    start: np.ndarray | int
    end: np.ndarray | int
    layers: str


def _at(places: np.ndarray | int, k: int) -> int:
    return places if isinstance(places, int) else int(places[k])


def matches(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Kind, start, end and value of the plain secrets of a text."""
    if NAMES.search(text.encode("utf-8", "surrogatepass")):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                yield "assign", m.start(), m.end(), m[2]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end(), m[0]


def opened(data: bytes, limit: int) -> tuple[str, bytes] | None:
    """Name of the format and contents of compressed bytes; None for other bytes. More than ``limit`` bytes raise OverflowError."""
    try:
        if data[:3] == b"\x1f\x8b\x08" or data[:2] in (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"):
            gzip = data[0] == 0x1F
            reader = zlib.decompressobj(31 if gzip else 15)
            name, out, done = ("gzip" if gzip else "zlib"), reader.decompress(data, limit + 1), lambda: reader.eof
        elif data[:3] == b"BZh":
            bz = bz2.BZ2Decompressor()
            name, out, done = "bzip2", bz.decompress(data, limit + 1), lambda: bz.eof
        elif data[:6] == b"\xfd7zXZ\x00":
            xz = lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=1 << 28)
            name, out, done = "xz", xz.decompress(data, limit + 1), lambda: xz.eof
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data) as stream:
                name, out, done = "zstd", stream.read(limit + 1), lambda: True
        else:
            return None
    except (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError):
        return None
    if len(out) > limit:
        raise OverflowError
    return (name, out) if done() else None


def _plain(data: bytes) -> str | None:
    """Bytes as text, if they are UTF-8 without control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return None if CONTROL.search(text) else text


def _characters(data: bytes) -> list[tuple[str, int]]:
    """Characters of bytes in UTF-8 with their lengths; bytes that aren't UTF-8 are characters of their own."""
    out: list[tuple[str, int]] = []
    while data:
        try:
            return out + [(c, len(c.encode())) for c in data.decode()]
        except UnicodeDecodeError as bad:
            out += [(c, len(c.encode())) for c in data[: bad.start].decode()] + [(chr(data[bad.start]), 1)]
            data = data[bad.start + 1 :]
    return out


class _Unwrapping:
    def __init__(self, limit: int):
        self.left, self.closed = limit, 0

    def _layer(self, text: str, start: np.ndarray | int, end: np.ndarray | int, layers: str) -> Iterator[Layer]:
        if len(text) > self.left:
            self.closed += 1
            return
        self.left -= len(text)
        yield Layer(text, start, end, layers)

    def _bytes(self, layer: Layer, data: bytes, start: int, end: int, name: str) -> Iterator[Layer]:
        """The text inside compressed bytes that stand at a part of a layer, compressed any number of times."""
        name = f"{layer.layers}>{name}".lstrip(">")
        try:
            seen = set()
            while (found := opened(data, self.left)) and found[1] not in seen:
                name, data = f"{name}>{found[0]}", found[1]
                seen.add(data)
        except OverflowError:
            self.closed += 1
            return
        if seen and (text := _plain(data)):
            yield from self._layer(text, _at(layer.start, start), _at(layer.end, end - 1), name)

    def _replaced(self, layer: Layer, name: str, parts: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Iterator[Layer]:
        """The layer with parts replaced by characters, each with its own place in the layer."""
        if not parts:
            return
        text, first, last, at = [], [], [], 0
        n = len(layer.text)
        for start, end, chars in [*parts, (n, n, [])]:
            text.append(layer.text[at:start])
            first.append(np.arange(at, start))
            last.append(np.arange(at, start))
            text += [c for c, _, _ in chars]
            first.append(np.array([a for _, a, _ in chars], np.int64))
            last.append(np.array([b - 1 for _, _, b in chars], np.int64))
            at = end
        start, end = layer.start, layer.end
        if not isinstance(start, int):
            start, end = start[np.concatenate(first)], end[np.concatenate(last)]
        yield from self._layer("".join(text), start, end, f"{layer.layers}>{name}".lstrip(">"))

    def percent(self, layer: Layer) -> Iterator[Layer]:
        if "%" not in layer.text:
            return
        parts = []
        for run in ESCAPED.finditer(layer.text):
            raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), run[0].encode("utf-8", "surrogatepass"))
            yield from self._bytes(layer, raw, run.start(), run.end(), "url")
        for m in PERCENT.finditer(layer.text):
            at, chars = m.start(), []
            for c, size in _characters(bytes.fromhex(m[0].replace("%", ""))):
                chars.append((c, at, at + 3 * size))
                at += 3 * size
            parts.append((m.start(), m.end(), chars))
        yield from self._replaced(layer, "url", parts)

    def unicode(self, layer: Layer) -> Iterator[Layer]:
        if "\\" not in layer.text and "&#" not in layer.text:
            return
        parts = []
        for m in UNICODE.finditer(layer.text):
            braces, high, low, four, eight, run, decimal, hexa, plain = m.groups()
            if run:
                data, at, chars = bytes.fromhex(run.replace("\\x", "")), m.start(), []
                yield from self._bytes(layer, data, m.start(), m.end(), "unicode")
                for c, size in _characters(data):
                    chars.append((c, at, at + 4 * size))
                    at += 4 * size
            elif plain:
                chars = [(PLAIN_ESCAPES.get(plain, plain), m.start(), m.end())]
            else:
                point = 0x10000 + ((int(high, 16) - 0xD800) << 10) + int(low, 16) - 0xDC00 if high else int(decimal) if decimal else int(braces or four or eight or hexa, 16)
                c = chr(point) if point < 0xD800 or 0xDFFF < point <= 0x10FFFF else "\ufffd"
                chars = [(c, m.start(), m.end())]
            parts.append((m.start(), m.end(), chars))
        yield from self._replaced(layer, "unicode", parts)

    def base64(self, layer: Layer) -> Iterator[Layer]:
        for whole in BASE64.finditer(layer.text):
            runs = {whole.span()}
            if any(c in whole[0] for c in "+/_-"):
                runs |= {(whole.start() + m.start(), whole.start() + m.end()) for a in ALPHABETS for m in a.finditer(whole[0])}
            for start, end in sorted(runs):
                run = layer.text[start:end]
                if len(run) % 4 == 1:
                    continue
                try:
                    data = base64.urlsafe_b64decode(run.replace("+", "-").replace("/", "_") + "=" * (-len(run) % 4))
                except binascii.Error:
                    continue
                yield from self._bytes(layer, data, start, end, "base64")
                if len(run) >= LEAST_RUN and (text := _plain(data)):
                    size = np.fromiter((len(c.encode()) for c in text), np.int64, len(text))
                    upto = np.cumsum(size)
                    first, last = start + (upto - size) * 4 // 3, start + (upto * 4 + 2) // 3 - 1
                    if not isinstance(layer.start, int):
                        first, last = layer.start[first], layer.end[last]
                    else:
                        first, last = layer.start, layer.end
                    yield from self._layer(text, first, last, f"{layer.layers}>base64".lstrip(">"))


def scan(text: str | None, limit: int = LIMIT) -> tuple[list[Found], int]:
    """Secrets of a text and its layers by start, kind and end, one for each kind, span and value; and how many layers stay closed."""
    text = text or ""
    work = deque([Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1), "")] if text else [])
    out: dict[tuple[int, int, int, str], Found] = {}
    seen: set[bytes] = set()
    unwrap = _Unwrapping(limit)
    while work:
        layer = work.popleft()
        for kind, start, end, value in matches(layer.text):
            first, last = _at(layer.start, start), _at(layer.end, end - 1)
            out.setdefault((first, KINDS.index(kind), last, value), Found(kind, first, last, value, layer.layers))
        for inner in (*unwrap.percent(layer), *unwrap.unicode(layer), *unwrap.base64(layer)):
            key = xxhash.xxh3_128(inner.text.encode("utf-8", "surrogatepass"))
            key.update(repr((inner.start, inner.end)).encode() if isinstance(inner.start, int) else inner.start.tobytes() + inner.end.tobytes())
            if key.digest() not in seen:
                seen.add(key.digest())
                work.append(inner)
    return [out[k] for k in sorted(out)], unwrap.closed


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string()), ("layers", pa.string())])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, found, unopened`` for each row: the secrets with their spans in code points (end exclusive), values and layers.

    ``layers`` is empty for those of the text itself, else how they are wrapped (``base64>gzip``). Null and empty texts have
    none. Texts are read whole at any length; decoded layers of one text may have ``limit`` characters together, and layers
    beyond that are counted in ``unopened``. Rows that repeat, or have no id, are rows of their own. Other columns aren't read.
    """

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan(t.as_py(), limit) for t in batch.column("text")]
            found = pa.array([[f._asdict() for f in g[0]] for g in got], pa.list_(_SPAN))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found, pa.array([g[1] for g in got], pa.int32())], names=["doc_id", "found", "unopened"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(rows_of, f"doc_id {dict(rows.dtypes)['doc_id']}, found array<struct<kind string, start bigint, end bigint, secret string, layers string>>, unopened int")


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts and a digest of the plain spans, all spans as text, and the number of those inside layers."""
    base = F.filter("found", lambda x: x["layers"] == "")
    text = lambda xs: F.array_join(F.array_distinct(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))), ",")
    number = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")

    counts: list[Column] = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: x["layers"] != "")).cast("long").alias("n_layered"), "unopened")
