"""Phrase collocations by vertical partitioning of suffixes.

Texts (A-Z lower-cased) are pieces between ``[.,;:!?\\x0A-\\x0D]`` and words ``[^\\x20\\x09]+``; everything is counted per language.

1. Words are counted. Frequent ones set bits in a map of fixed size; a rare word ends every phrase, as no phrase
   through it can be frequent. The same is done for pairs of words, and longer phrases of frequent pairs are counted in a fixed
   number of shared counters. Bits and counters are shared by hashes, so they let too much pass
   at worst: the more phrases there are for their size, the less they save, and counts never depend on them.
2. Every position begins a suffix of at most five words, cut where a pair or its own beginning is rare. Equal ones are summed by task.
3. Prefixes are grouped by budget: a word goes to a group by hash with all suffixes that it begins; one with more positions than
   a fraction of the budget is lengthened to pairs, and a pair with as many to whole suffixes. Counts are known from the steps
   before. Only these few prefixes, whose number is bounded by that of the groups, are sent to all tasks.
4. Each group is sorted by Spark, which is the leaf order of its depth-truncated suffix tree. A node is an interval of
   leaves, and its count is their total. A task holds one path of the tree. Nodes above the cut of a lengthened prefix
   are in several groups; their totals are added at the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import bitmap, has
from .common import join_small, materialise, stored
from .shingles import mix64

LEAST, TOP, LONGEST = 100, 2000, 5
#: Positions of a group; at most so many groups, so that lengthened prefixes stay few.
BUDGET, MOST_GROUPS = 500_000, 20_000
#: Bits of the maps of frequent words and pairs (2 and 8 MB) and counters of longer phrases (8 MB a task), as powers of two.
WORD_BITS, PAIR_BITS, PHRASE_COUNTERS = 24, 26, 23
#: Counters that travel as one value.
COUNTER_CHUNK = 1 << 16
#: What a task sums before it passes rows on.
HELD_KEYS, HELD_PAIRS, HELD_TOKENS = 200_000, 1_000_000, 200_000

#: A-Z lower-cased, the ends of pieces as full stops (which no word holds), tabs as spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def tokens(text: str | None) -> list[bytes]:
    """Words of a text in order, with ``.`` between pieces."""
    return text.encode().translate(_PLAIN).replace(b".", b" . ").split() if text else []


class _Hashes(dict):
    """Word to an odd 64-bit hash under a language; the end of a piece is 0."""

    def __init__(self, lang: str, limit: int = 200_000):
        super().__init__()
        self.seed, self.limit = xxhash.xxh32_intdigest(lang.encode()), limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = 0 if word == b"." else xxhash.xxh3_64_intdigest(word, self.seed) | 1
        return value


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Language and tokens of some whole texts of one language, with a piece's end between texts."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            found = tokens(text.as_py())
            if found:
                held.setdefault(lang, []).extend([*found, b"."])
                if len(held[lang]) >= HELD_TOKENS:
                    yield lang, held.pop(lang)
        yield from held.items()


def _flushed(counters: dict[str, Counter], name: str) -> pa.RecordBatch:
    langs = [k for k, c in counters.items() for _ in range(len(c))]
    keys = pa.array([x for c in counters.values() for x in c], pa.binary()).cast(pa.string())
    counts = pa.array([x for c in counters.values() for x in c.values()], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), keys, counts], names=["lang", name, "c"])


def _summed(found: Iterator[tuple[str, list[bytes]]], name: str) -> Iterator[pa.RecordBatch]:
    """Counts by language and key, passed on whenever many are held."""
    counters: dict[str, Counter] = {}
    for lang, keys in found:
        counters.setdefault(lang, Counter()).update(keys)
        if sum(map(len, counters.values())) >= HELD_KEYS:
            yield _flushed(counters, name)
            counters.clear()
    if counters:
        yield _flushed(counters, name)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _summed(((lang, [t for t in found if t != b"."]) for lang, found in _chunks(batches)), "word")


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes: dict[str, _Hashes] = {}
    for b in batches:
        h = [hashes.setdefault(lang, _Hashes(lang))[word.encode()] for lang, word in zip(b.column("lang").to_pylist(), b.column("word").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(h, _U).view(np.int64))], names=["h"])


class _Pairs:
    """Hashes of neighbouring frequent words by position; 0 where a piece ends or a word is rare."""

    def __init__(self, words: np.ndarray):
        self.words, self.hashes = words, {}

    def __call__(self, lang: str, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words (0: none or rare) and of the pairs that begin with them."""
        known = self.hashes.setdefault(lang, _Hashes(lang))
        ids = np.fromiter(map(known.__getitem__, found), _U, len(found))
        ids[~has(self.words, ids)] = 0
        both = (ids[:-1] != 0) & (ids[1:] != 0)
        return ids, np.where(both, (ids[:-1] * _STEP + ids[1:]) | _U(1), _U(0))


def _pair_rows(words) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held, n = _Pairs(words.value), [], 0
        for lang, found in _chunks(batches):
            _, h = pairs(lang, found)
            held.append(h[h != 0])
            n += len(held[-1])
            if n >= HELD_PAIRS:
                yield summed(held)
                held, n = [], 0
        if held:
            yield summed(held)

    return rows_of


def _longer(ids: np.ndarray, h: np.ndarray, on: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 3, 4, ... words by position: whether all their pairs are frequent (``on``), and their hashes."""
    whole = on
    for k in range(3, longest + 1):
        n = len(ids) - k + 1
        if n <= 0:
            return
        whole = whole[:n] & on[k - 2 : k - 2 + n]
        h = mix64(h[:n] * _STEP + ids[k - 1 :])
        yield whole, h


def _counter_rows(words, frequent, longest: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's counters of longer phrases, in chunks. A counter stops at ``least``: the sum over tasks reaches it just the same."""
    kind = np.uint8 if least < 1 << 8 else np.uint16 if least < 1 << 16 else np.int64

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counters = _Pairs(words.value), np.zeros(1 << PHRASE_COUNTERS, kind)
        for lang, found in _chunks(batches):
            ids, h = pairs(lang, found)
            for whole, g in _longer(ids, h, (h != 0) & has(frequent.value, h), longest):
                at, c = np.unique((mix64(g[whole]) >> _U(64 - PHRASE_COUNTERS)).astype(np.int64), return_counts=True)
                counters[at] = np.minimum(counters[at].astype(np.int64) + c, least)
        for k in range(0, len(counters), COUNTER_CHUNK):
            part = counters[k : k + COUNTER_CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // COUNTER_CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "counters"])

    return rows_of


def _phrase_bits(counters: DataFrame, least: int) -> np.ndarray:
    """Map of the counters that reach ``least`` in all tasks together; a bit each comes to the driver."""
    kind = np.uint8 if least < 1 << 8 else np.uint16 if least < 1 << 16 else np.int64

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, x in zip(b.column("chunk").to_pylist(), b.column("counters"), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(x.as_py(), kind).astype(np.int64)
        packed = [np.packbits(t >= least, bitorder="little").tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "bits"])

    out = np.zeros(1 << (PHRASE_COUNTERS - 6), _U)
    words = COUNTER_CHUNK >> 6
    for r in counters.repartition("chunk").mapInArrow(added, "chunk int, bits binary").toArrow().to_pylist():
        out[r["chunk"] * words : (r["chunk"] + 1) * words] = np.frombuffer(r["bits"], _U)
    return out


class _Routes:
    """Group and length of the prefix that decides it, by suffix."""

    def __init__(self, hot_words: set[tuple[str, str]], hot_pairs: np.ndarray, groups: int, longest: int):
        self.words = {(lang, word.encode()) for lang, word in hot_words}
        self.pairs, self.groups, self.longest = set(hot_pairs.tolist()), groups, longest

    def of(self, lang: str, known: _Hashes, suffix: bytes) -> tuple[int, int]:
        first, _, rest = suffix.partition(b" ")
        if (lang, first) not in self.words:
            return known[first] % self.groups, 1
        h = _pair_hash(known[first], known[rest.partition(b" ")[0]])
        if h not in self.pairs:
            return h % self.groups, 2
        return xxhash.xxh3_64_intdigest(suffix, known.seed) % self.groups, self.longest


def _pair_hash(a: int, b: int) -> int:
    return ((a * int(_STEP) + b) & (1 << 64) - 1) | 1


def _suffix_rows(words, frequent, phrases, hot, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def suffixes(batches: Iterator[pa.RecordBatch], pairs: _Pairs) -> Iterator[tuple[str, list[bytes]]]:
        for lang, found in _chunks(batches):
            ids, h = pairs(lang, found)
            on = (h != 0) & has(frequent.value, h)
            depth, alive = 1 + on.astype(np.int64), on
            for whole, g in _longer(ids, h, on, longest):
                alive = alive[: len(whole)] & whole & has(phrases.value, g)
                depth[: len(alive)] += alive
            at = np.flatnonzero(depth > 1)
            yield lang, [b" ".join(found[i:j]) for i, j in zip(at.tolist(), (at + depth[at]).tolist(), strict=True)]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, routes = _Pairs(words.value), _Routes(*hot.value, longest)
        for b in _summed(suffixes(batches, pairs), "suffix"):
            to = [routes.of(lang, pairs.hashes[lang], s.encode()) for lang, s in zip(b.column("lang").to_pylist(), b.column("suffix").to_pylist(), strict=True)]
            group, cut = zip(*to, strict=True) if to else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), *b.columns, pa.array(cut, pa.int8())], names=["group", "lang", "suffix", "c", "cut"])

    return rows_of


def _node_rows(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the tree's nodes from its leaves in order: ``group, lang, words, c, cut``; nodes of one word are left out."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[list] = []  # word, total of leaves so far, whether other groups have the node
        head, out = None, []

        def leave(depth: int) -> None:
            while len(path) > depth:
                word, total, shared = path.pop()
                if path:
                    path[-1][1] += total
                    if shared or total >= least:
                        out.append((head[1], " ".join([*(p[0] for p in path), word]), len(path) + 1, total))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["lang", "phrase", "words", "f"])

        for b in batches:
            for group, lang, words, c, cut in zip(*(b.column(n).to_pylist() for n in ("group", "lang", "w", "c", "cut")), strict=True):
                if head != (group, lang):
                    leave(0)
                    head = (group, lang)
                same = 0
                while same < min(len(path), len(words)) and path[same][0] == words[same]:
                    same += 1
                leave(same)
                path += [[w, 0, same + k + 1 < cut] for k, w in enumerate(words[same:])]
                path[-1][1] += c
            yield batch_of()
        leave(0)
        yield batch_of()

    return rows_of


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of every phrase of 1 to ``longest`` words that occurs ``least`` times or more, and ``lang, n``, all words.

    A null language is ``und``. Null, empty and blank texts have no words; texts of any length are read whole. Repeated rows
    count as often as they are there. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = stored(rows.mapInArrow(_word_rows, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("f")))
    n = materialise(words.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = words.where(F.col("f") >= least)
    word_bits = spark.sparkContext.broadcast(bitmap(frequent.mapInArrow(_hash_rows, "h long"), WORD_BITS))
    pairs = stored(rows.mapInArrow(_pair_rows(word_bits), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least))
    pair_bits = spark.sparkContext.broadcast(bitmap(pairs.select("h"), PAIR_BITS))
    total = pairs.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    budget = max(budget, -(-total // MOST_GROUPS))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // budget))
    # At most 4 * MOST_GROUPS words, and as many pairs, have more than these quarters.
    limit = max(budget, -(-n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // MOST_GROUPS)) // 4
    hot_words = {(r["lang"], r["word"]) for r in frequent.where(F.col("f") > limit).select("lang", "word").collect()}
    hot_pairs = pairs.where(F.col("c") > budget // 4).select("h").toArrow()["h"].to_numpy().view(_U)
    hot = spark.sparkContext.broadcast((hot_words, hot_pairs, groups))
    phrase_bits = spark.sparkContext.broadcast(_phrase_bits(rows.mapInArrow(_counter_rows(word_bits, pair_bits, longest, least), "chunk int, counters binary"), least))
    suffixes = rows.mapInArrow(_suffix_rows(word_bits, pair_bits, phrase_bits, hot, longest), "group int, lang string, suffix string, c long, cut byte")
    leaves = suffixes.repartition(groups, "group").withColumn("w", F.split("suffix", " ")).drop("suffix").sortWithinPartitions("group", "lang", "w")
    nodes = leaves.mapInArrow(_node_rows(least), "lang string, phrase string, words int, f long")
    phrases = nodes.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return stored(phrases.unionByName(frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "f"))), n


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", salts: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by their lowest-scoring cut.

    A cut has the score ``floor(1000 * a * n / (l * r))``, in decimal arithmetic. A phrase inside a longer one of the same count
    goes: then one that is a single word longer has that count too, as counts fall with length, so only those are asked.
    Ties go to the smaller cut, then to the higher count, then to the phrase that is first in byte order. No documents: no rows.
    """
    known, n = phrase_counts(docs, least, budget, longest, text_col, lang_col)
    longer = known.where("words > 2").select("lang", F.col("f").alias("a"), F.explode(F.array(F.expr("substring(phrase, instr(phrase, ' ') + 1)"), F.expr("substring_index(phrase, ' ', words - 1)"))).alias("phrase"))
    cuts = known.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.col("words").alias("size"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.join(longer, ["lang", "phrase", "a"], "left_anti")
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    both = join_small(both, n, ["lang"], n.count())
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    scored = both.withColumn("score", F.expr(f"(1000 * ({wide('a')} * {wide('n')})) div ({wide('l')} * {wide('r')})").cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # Each share of a language sends its first ones only, so a task gets at most top * salts rows.
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
