"""Media columns: bytes stored as 8-bit PCM in Matroska, and a parser of Matroska into packet tables.

The parser reads variable-length EBML elements (ids, sizes, unknown sizes), clusters, simple blocks and block groups,
the three kinds of lacing, and cues. It runs per row inside Arrow batches; a row's bytes are held whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 576
RATE = 48_000
FRAMES_PER_BLOCK = 64
BLOCKS_PER_CLUSTER = 16

#: Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, SCALE, DURATION, TRACK, TRACK_NUMBER, TRACK_TYPE, CODEC, AUDIO, FREQUENCY, CHANNELS, DEPTH = 0x4282, 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xA3, 0xA0, 0xA1, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DEFAULT_DURATION, TRACK_UID = 0x23E383, 0x73C5
TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML}


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    start: int
    size: int
    keyframe: bool
    cluster: int


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones mean an unknown size, so they are never used for a value."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def read_vint(data: bytes, at: int, *, keep_marker: bool = False) -> tuple[int, int]:
    """Value and the next position; -1 is an unknown size."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer of up to 8 bytes at {at}")
    width = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    if len(data) < at + width:
        raise ValueError("the data ends inside a variable-length integer")
    if keep_marker:
        return raw, at + width
    value = raw & ((1 << 7 * width) - 1)
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def children(data: bytes, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Id, body start and body end of the elements in a range. An element of unknown size ends before the next top-level one."""
    at = start
    while at < end:
        ident, at = read_vint(data, at, keep_marker=True)
        size, at = read_vint(data, at)
        if size < 0:
            stop = at
            while stop < end and not (ident != SEGMENT and read_vint(data, stop, keep_marker=True)[0] in TOP):
                _, after = read_vint(data, stop, keep_marker=True)
                inner, after = read_vint(data, after)
                stop = end if inner < 0 else after + inner
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {ident:x} ends beyond its parent")
        yield ident, at, stop
        at = stop


def number(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def laced_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Frame sizes of a block's body and where the first frame begins. Lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if lacing == 0:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("fixed lacing doesn't divide the block")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            before = at
            size, at = read_vint(data, at)
            if k:  # the others are differences, shifted by half the range of their width
                size = sizes[-1] + size - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames exceed their block")
    return sizes, at


def laced(frames: list[bytes], lacing: int) -> bytes:
    """A block's body: lacing head and frames."""
    if lacing == 0:
        return frames[0]
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3 and len(sizes) > 1:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file whose one track holds the payload as mono 8-bit PCM, ``FRAME`` samples a frame.

    Blocks rotate through fixed, EBML and Xiph lacing; a last single frame is not laced. The result depends on nothing
    but the payload. Cues come before the clusters with positions of a fixed width.
    """
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ns_per_frame = FRAME * 1_000_000_000 // RATE  # 12 ms
    clusters, per = [], FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for first in range(0, len(frames), per):
        base = first * ns_per_frame // 1_000_000
        body = [uint(TIMESTAMP, base)]
        for at in range(first, min(first + per, len(frames)), FRAMES_PER_BLOCK):
            block = frames[at : at + FRAMES_PER_BLOCK]
            lacing = 0 if len(block) == 1 else (2, 3, 1)[at // FRAMES_PER_BLOCK % 3]
            relative = at * ns_per_frame // 1_000_000 - base
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", relative, 0x80 | lacing << 1) + laced(block, lacing)))
        clusters.append((base, element(CLUSTER, b"".join(body))))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    track = element(TRACK, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, ns_per_frame) + audio)
    head = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * ns_per_frame / 1e6))) + element(TRACKS, track)

    def cues(start: int) -> bytes:
        points, at = [], start
        for base, cluster in clusters:
            points.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + element(CUE_CLUSTER, at.to_bytes(8, "big")))))
            at += len(cluster)
        return element(CUES, b"".join(points))

    index = cues(len(head) + len(cues(0)))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, head + index + b"".join(c for _, c in clusters))


def demux(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]]]:
    """Packets (byte ranges of frames, in file order) and cues (time in ns, track, absolute position of the cluster)."""
    packets, cues = [], []
    for ident, start, end in children(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        scale, durations = 1_000_000, {}
        for part, a, b in children(data, start, end):
            if part == INFO:
                scale = next((number(data, x, y) for k, x, y in children(data, a, b) if k == SCALE), scale)
            elif part == TRACKS:
                for k, x, y in children(data, a, b):
                    if k == TRACK:
                        own = {i: number(data, p, q) for i, p, q in children(data, x, y) if i in (TRACK_NUMBER, DEFAULT_DURATION)}
                        durations[own.get(TRACK_NUMBER, 0)] = own.get(DEFAULT_DURATION, 0)
            elif part == CUES:
                for k, x, y in children(data, a, b):
                    if k != CUE_POINT:
                        continue
                    inner = list(children(data, x, y))
                    time = next((number(data, p, q) for i, p, q in inner if i == CUE_TIME), 0)
                    for i, p, q in inner:
                        if i == CUE_POSITIONS:
                            own = {j: number(data, u, v) for j, u, v in children(data, p, q)}
                            cues.append((time * scale, own.get(CUE_TRACK, 0), start + own.get(CUE_CLUSTER, 0)))
            elif part == CLUSTER:
                base = 0
                for k, x, y in children(data, a, b):
                    if k == TIMESTAMP:
                        base = number(data, x, y)
                    elif k == SIMPLE_BLOCK:
                        packets += _block(data, x, y, base, scale, durations, a)
                    elif k == BLOCK_GROUP:
                        for i, p, q in children(data, x, y):
                            if i == BLOCK:
                                packets += _block(data, p, q, base, scale, durations, a)
    return packets, cues


def _block(data: bytes, at: int, end: int, base: int, scale: int, durations: dict[int, int], cluster: int) -> list[Packet]:
    track, at = read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    sizes, at = laced_sizes(data, at + 3, end, flags >> 1 & 3)
    time, out = (base + relative) * scale, []
    for k, size in enumerate(sizes):
        out.append(Packet(track, time + k * durations.get(track, 0), at, size, bool(flags & 0x80), cluster))
        at += size
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def features(samples: np.ndarray, packets: list[Packet], cues: int) -> str:
    """Packet and signal features of the samples that were read back."""
    per = samples.reshape(-1, FRAME).astype(np.int64) - 128 if len(samples) % FRAME == 0 and len(samples) else np.zeros((1, 1), np.int64)
    end = (packets[-1].timestamp_ns + FRAME * 1_000_000_000 // RATE) // 1_000_000 if packets else 0
    crossings = int((np.diff(np.signbit(per), axis=1) != 0).sum())
    energy = (per * per).sum(1)
    return f"packets={len(packets)};clusters={len({p.cluster for p in packets})};cues={cues};ms={end};sum={int(per.sum())};energy={int(energy.sum())};peak={int(energy.max())};crossings={crossings}"


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            n, payload = payload_of(text)
            media = mux(payload)
            packets, cues = demux(media)
            back = b"".join(media[p.start : p.start + p.size] for p in packets)
            rows.append((n, len(back), sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), sha256(media).hexdigest(), features(np.frombuffer(back, np.uint8), packets, len(cues))))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the digests of its text's payload, read back from Matroska, and of the stored form.

    A null text counts as empty: one frame of bytes 255. Equal texts give equal values; repeated rows stay rows of their
    own. Other columns aren't read.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_media, schema)


def _mux_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mux(payload_of(t)[1]) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: each text's payload as a Matroska file."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_mux_rows, "doc_id long, media binary")


def _packet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for ident, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out += [(ident, k, *p) for k, p in enumerate(demux(media)[0] if media else [])]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "packet", *Packet._fields])


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: track, timestamp, byte range, keyframe flag, start of its cluster. Null media give no row; broken media raise."""
    schema = "doc_id long, packet long, track long, timestamp_ns long, start long, size long, keyframe boolean, cluster long"
    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(_packet_rows, schema)
