"""Substring deduplication by line hashing.

Texts are cut into lines and, inside them, at the ends of sentences and clauses; what has words is a unit. Units are normalised (A-Z
lower-cased, white space to single spaces), their 128-bit digests are grouped over all documents, and the occurrence
ranked first by (document, unit) stays. Later occurrences are removed where a run of adjacent ones has at least
``min_words`` words, so short units that texts share by chance or custom stay. A passage that begins and ends inside a
unit loses its first and last part from the count: the threshold is 35 words so that passages of over 50 are caught.
Original offsets are retained. ``later_occurrences`` returns every later occurrence, flagged where that rule removes it.

Units move as digests. Groups meet in partial aggregates and are written; those with more than one unit set bits in a map of fixed size,
so that of the second pass over the texts hardly any units but repeated ones are joined with them, by a plain equi-join that AQE splits.
Only what repeats goes on to the run lengths, which are computed per document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap, has
from .common import materialise
from .shingles import LOWER, WORD_BYTES

MIN_WORDS = 35
LINE_END = re.compile("\n")
#: A line end, the space behind the last mark of a sentence or clause, or the place behind a full-width mark.
SENTENCE_END = re.compile("\n|(?<=[.!?,;:\u2026])[\x20\x09-\x0D]|(?<=[\u3002\uff01\uff1f\uff0c\u3001\uff1b\uff1a])(?![\u3002\uff01\uff1f\uff0c\u3001\uff1b\uff1a\n])")
#: Bits of the map of repeated digests, as a power of two: 8 MB.
REPEATED_BITS = 26


def _pieces(text: str, end: re.Pattern[str]) -> Iterator[tuple[int, str]]:
    at = 0
    for m in end.finditer(text):
        yield at, text[at : m.start()]
        at = m.end()
    yield at, text[at:]


def units(text: str | None, sentences: bool = False) -> list[tuple[int, int, int, int, int, int, bool]]:
    """Unit number, start and end in code points, words, digest as two signed longs, and whether it is the text's first such unit."""
    out, seen = [], set()
    for at, line in _pieces(text or "", SENTENCE_END if sentences else LINE_END):
        words = WORD_BYTES.findall(line.encode().translate(LOWER))
        if words:
            d = xxhash.xxh3_128_digest(b" ".join(words))
            out.append((len(out), at, at + len(line), len(words), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), d not in seen))
            seen.add(d)
    return out


def _digest_rows(sentences: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Document and digest of each distinct unit, and how often the document has it."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for ident, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(ident, h, *key, n) for key, n in Counter(u[4:6] for u in units(text, sentences)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "h", "h1", "h2", "n"])

    return rows_of


def _unit_rows(sentences: bool, repeated) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["doc_id", "h", "unit", "start", "end", "words", "h1", "h2", "first"]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for ident, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(ident, h, *u) for u in units(text, sentences)]
            on = has(repeated.value, np.array([r[6] for r in rows], np.int64).view(np.uint64)).tolist()
            rows = [r for r, x in zip(rows, on, strict=True) if x]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return rows_of


def _later(docs: DataFrame, min_words: int, id_col: str, text_col: str, sentences: bool) -> DataFrame:
    """Later occurrences by document, which is an id (or none) and the hash ``h`` of a text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    digests = rows.mapInArrow(_digest_rows(sentences), "doc_id long, h long, h1 long, h2 long, n long")
    groups = materialise(digests.groupBy("h1", "h2").agg(F.min(key).alias("low"), F.sum("n").alias("n")).where("n > 1").drop("n"))
    repeated = docs.sparkSession.sparkContext.broadcast(bitmap(groups.select(F.col("h1").alias("h")), REPEATED_BITS))
    found = rows.mapInArrow(_unit_rows(sentences, repeated), "doc_id long, h long, unit int, start long, end long, words long, h1 long, h2 long, first boolean")
    later = found.join(groups, ["h1", "h2"]).where(~key.eqNullSafe(F.col("low")) | ~F.col("first"))
    once = later.groupBy("doc_id", "h", "unit").agg(*[F.min(c).alias(c) for c in ("start", "end", "words")], F.min("low.doc_id").alias("first_doc_id"))
    runs = once.withColumn("run", F.col("unit") - F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("unit")))
    return runs.withColumn("run_words", F.sum("words").over(Window.partitionBy("doc_id", "h", "run"))).withColumn("removed", F.col("run_words") >= min_words)


def later_occurrences(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", sentences: bool = True) -> DataFrame:
    """One row per later occurrence of a unit: ``doc_id, unit, start_char, end_char, n_words, run_words, first_doc_id, removed``.

    ``removed`` is false where the run of adjacent later occurrences has fewer than ``min_words`` words. A null, empty or
    blank text has no unit. Rows that repeat id and text are one document; rows that share an id but not the text are
    documents of their own, ranked by the texts' hashes; rows without an id rank last. Texts of any length are read whole. Other columns aren't read.
    """
    out = _later(docs, min_words, id_col, text_col, sentences)
    return out.select("doc_id", "unit", F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.col("words").alias("n_words"), "run_words", "first_doc_id", "removed")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", sentences: bool = True) -> DataFrame:
    """The removed ones of ``later_occurrences``, without the flag."""
    return later_occurrences(docs, min_words, id_col, text_col, sentences).where("removed").drop("removed")


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", sentences: bool = True) -> DataFrame:
    """``docs`` with the repeated units cut out of the text, and their original offsets in ``removed_spans`` (null: none).

    A column ``removed_spans`` that ``docs`` has is replaced. Rows that repeat id and text lose the same spans.
    """
    span = F.struct(F.col("start").alias("start_char"), F.col("end").alias("end_char"))
    cuts = _later(docs, min_words, id_col, text_col, sentences).where("removed").groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    # Columns are inside structs, so that none of them clashes.
    whole, found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")), cuts.select(F.struct("doc_id", "h", "spans").alias("c"))
    out = whole.join(found, F.col("r")[id_col].cast("long").eqNullSafe(F.col("c.doc_id")) & (F.xxhash64(F.col("r")[text_col]) == F.col("c.h")), "left")
    # A removed unit goes with the line end or space behind it.
    cut = "aggregate(c.spans, struct('' as s, 1L as at), (a, x) -> struct(a.s || substring(r.`{t}`, cast(a.at as int), cast(greatest(x.start_char + 1 - a.at, 0) as int)) as s, x.end_char + 1 + if(substring(r.`{t}`, cast(x.end_char + 1 as int), 1) rlike '\\\\s', 1, 0) as at), a -> a.s || substring(r.`{t}`, cast(a.at as int)))".format(t=text_col)
    text = F.when(F.col("c").isNull(), F.col("r")[text_col]).otherwise(F.expr(cut))
    kept = [(text if c == text_col else F.col("r")[c]).alias(c) for c in docs.columns if c != "removed_spans"]
    return out.select(*kept, F.col("c.spans").alias("removed_spans"))
