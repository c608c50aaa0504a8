"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their frequency rank over the whole corpus, so frequent ids take one byte. Four ranks share a control
byte: two bits each give the number of data bytes, 1 to 4. Control and data bytes are separate columns of block rows,
which Spark writes as Parquet in ascending id order with the document index of each block. Decoding looks the lengths of
four values up by control byte in a numpy table.

Texts are encoded once. Pieces between white space are remembered with the ids that the whole tokenizer gives them: it
drops white space and no token spans it, so the pieces' ids in a row are the text's ids (tests compare whole texts, with
every code point of the basic plane).

Order is a range partitioning by (id, hash of the tokens, row), so neither one id nor one text has to fit a task. A
document's start is the sum of the range partitions before its own (one row each) and of the blocks before it inside.
"""

from __future__ import annotations

import os
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, stored

END_ID = 2
BLOCK_TOKENS = 1 << 20
#: Pieces, and words, that a process remembers; words that go through the tokenizer at a time.
PIECE_LIMIT, LEARN = 500_000, 8_192
#: Byte lengths of the four values of each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values; the last control byte is filled up with zeros."""
    values = np.ascontiguousarray(values, "<u4")
    extra = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    out = np.zeros((count, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


#: A word that is one token of its own, between words that are learned; a word with it in it is encoded alone.
_BETWEEN = "\u2022"
_MARKS, _LETTERS = frozenset(b".,;:!?"), frozenset(b"abcdefghijklmnopqrstuvwxyz")


def _word(piece: bytes) -> bytes:
    """A piece in lower case if it is ASCII and can't hold a special token, without a mark behind its last letter."""
    if piece.isascii() and b"<|" not in piece:
        piece = piece.lower()
    return piece[:-1] if piece[-1] in _MARKS and piece[-2:-1] and piece[-2] in _LETTERS else piece


class Pieces(dict):
    """Piece of text between ASCII white space to its ids as bytes of unsigned 32-bit integers; ``PIECE_LIMIT`` pieces at most.

    The tokenizer drops white space, no token spans it, and none of its steps looks across it. It puts ASCII in lower
    case, and a mark behind a letter is a word of its own, so pieces that differ by that are learned once. What isn't
    known goes through the whole tokenizer, ``LEARN`` words at a time, each behind a word whose one token shows where it
    begins.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self._ids(_BETWEEN)
        if len(self.between) != 1:
            raise ValueError("the word between words has to be one token")
        self.width = "<u2" if max(self.tokenizer.get_vocab().values()) < 1 << 16 else "<u4"
        self.words: dict[bytes, bytes] = {}
        self.new: dict[bytes, bytearray] = {}
        self.marks = {bytes([m]): self._ids(chr(m)).tobytes() for m in _MARKS}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        alone = {w for w in new if _BETWEEN.encode() in w}
        out = {w: self._ids(w.decode()).tobytes() for w in alone}
        new = [w for w in new if w not in alone] if alone else new
        mark = f" {_BETWEEN} ".encode()
        for at in range(0, len(new), LEARN):
            part = new[at : at + LEARN]
            ids = self._ids((mark + mark.join(part)).decode())
            raw, starts = ids.tobytes(), (4 * np.flatnonzero(ids == self.between[0])).tolist()
            out |= {w: raw[a + 4 : b] for w, a, b in zip(part, starts, [*starts[1:], len(raw)], strict=True)}
        return out

    def __missing__(self, piece: bytes) -> bytearray:
        """A piece that isn't known has an empty place in the text's ids, which is filled when all of them are learned."""
        return self.new.setdefault(piece, bytearray())

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        end, self.new = np.array([end_id], "<u4").tobytes(), {}
        found = [[*map(self.__getitem__, t.encode().split()), end] if t else [end] for t in texts]
        new, known = self.new, self.words
        words = [*map(_word, new)]
        learned = self._learn(list(set(words).difference(known)))
        known.update(learned)
        for (p, place), w in zip(new.items(), words, strict=True):
            place += known[w]
            if len(w) < len(p):
                place += self.marks[p[-1:]]
        out = [*map(b"".join, found)]
        # The first to come are the frequent ones: they stay.
        if len(self) + len(new) <= PIECE_LIMIT:
            self.update(zip(new, map(bytes, new.values()), strict=True))
        if len(known) > PIECE_LIMIT:
            for w in learned:
                del known[w]
        return out


def _pieces(path: str) -> Pieces:
    """The process's memory of pieces. Tasks unpickle this module's functions anew, so it is kept beside the loaded modules."""
    memory = sys.modules.setdefault("_fieldlift_pieces", types.ModuleType("_fieldlift_pieces"))
    if path not in memory.__dict__:
        memory.__dict__[path] = Pieces(path)
    return memory.__dict__[path]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # pieces of few texts at a time are held besides those remembered
                part = batch.slice(at, 1024)
                ids = [np.frombuffer(x, "<u4").astype(pieces.width).tobytes() for x in pieces.encode(part.column(1).to_pylist(), end_id)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _count_ids(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), width))
            if len(n) > len(total):
                total = np.r_[total, np.zeros(len(n) - len(total), np.int64)]
            total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return run


def _pack_blocks(rank_of: np.ndarray, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range partition come in order; a block ends with the partition or at ``BLOCK_TOKENS``."""
        part, no, ids, arrays, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block() -> pa.RecordBatch:
            control, data = encode_values(rank_of[np.concatenate(arrays)])
            row = [part, no, len(ids), size, ids, np.array([len(a) for a in arrays], "<u4").tobytes(), control, data]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "block", "docs", "tokens", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(doc_id)
                arrays.append(np.frombuffer(raw, width))
                size += len(arrays[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    no, ids, arrays, size = no + 1, [], [], 0
        if ids:
            yield block()

    return run


def _unpack_blocks(id_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, tokens, doc_ids, lengths, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, n = id_of[decode_values(control, data, tokens)], np.frombuffer(lengths, "<u4").astype(np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write ``path/blocks`` and ``path/ranks`` in ascending id order.

    A null or empty text is its end id alone. Rows that repeat an id follow one another, by the hash of their tokens;
    rows without an id come first. An empty table writes empty files. Texts of any length are encoded
    whole, word by word. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = rows.mapInArrow(_tokenise(tokenizer_path, end_id), "doc_id long, ids binary")
    tokens = stored(encoded.select("doc_id", F.xxhash64("ids").alias("h"), F.monotonically_increasing_id().alias("row"), "ids"))
    width = _pieces(tokenizer_path).width
    freq = tokens.select("ids").mapInArrow(_count_ids(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranks = freq.toPandas().sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy()  # one row per id of the vocabulary at most
    rank_of = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)
    spark = docs.sparkSession
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(ranks)), "id": ranks.astype(np.int64)}), "rank long, id long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row")]
    in_order = tokens.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    blocks = in_order.mapInArrow(_pack_blocks(rank_of, width), "part long, block long, docs long, tokens long, doc_ids array<long>, lengths binary, control binary, data binary")
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files alone; ``start`` is the number of ids of all documents before."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy()
    index = blocks.select("part", "block", "tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range partition
    bases = index.groupBy("part").agg(F.sum("tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    starts = index.withColumn("inside", within).join(bases, "part").select("part", "block", (F.col("base") + F.col("inside")).alias("start"))
    rows = blocks.join(starts, ["part", "block"]).select("start", "tokens", "doc_ids", "lengths", "control", "data")
    id_of = ranks.astype(np.uint32) if len(ranks) else np.zeros(1, np.uint32)
    return rows.mapInArrow(_unpack_blocks(id_of), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer_path: str, *, end_id: int = END_ID) -> DataFrame:
    """Write to the shared folder of the session and read back."""
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id=end_id)
    return read_tokens(docs.sparkSession, path)
