"""Exact deduplication by deterministic block naming, with DataFrame functions only.

A text without its white space is cut into blocks of a fixed number of bytes. The distinct blocks are sorted inside
hash partitions and numbered, so a block's integer name is (partition, rank in it). Then adjacent pairs of names are
named in the same way, level by level, until one name is left of each document. Equal (level, name) means equal text:
names are given to contents, so no digest decides equality.

Contents are shuffled once (after a map-side ``distinct``); documents find the names of their blocks through a
128-bit digest of the block, once it is shown that no two distinct blocks share one, and through the contents
themselves if two do. Joins on hot names are plain equi-joins, which AQE splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise

BLOCK_BYTES = 8192


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Give each row of a hash-partitioned, distinct frame an integer that follows the sort order in its partition."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def _digest(block: str = "block") -> list:
    return [F.xxhash64(block).alias("h1"), F.xxhash64(F.lit(0x5DEECE66D), F.col(block), F.octet_length(block)).alias("h2")]


def document_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, *, by_content: bool = False) -> DataFrame:
    """One row per distinct (id, text): ``doc_id, sha, n_cp, copies, level, name``.

    ``sha`` is the SHA-256 of the normalised text in UTF-8, ``n_cp`` the code points of the original text, ``copies``
    the number of input rows that are this very row. A null text counts as empty. ``by_content`` joins blocks by their
    bytes even if no digests collide.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("n_cp"), F.regexp_replace(text, f"{SPACE}+", "").cast("binary").alias("body"))
    body = body.withColumn("nb", F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(block_bytes)).cast("int")))
    cut = F.posexplode(F.expr(f"transform(sequence(0, nb - 1), i -> substring(body, i * {block_bytes} + 1, {block_bytes}))")).alias("pos", "block")
    blocks = body.select(cut).select("block")
    placed = body.select("doc_id", F.unhex(F.sha2("body", 256)).alias("sha"), "n_cp", "nb", cut)

    names = _named(blocks.distinct(), ["block"])
    if not by_content:
        digests = materialise(names.select(*_digest(), "name"))
        by_content = not digests.groupBy("h1", "h2").count().where("count > 1").isEmpty()
    if by_content:
        placed = placed.join(names, "block").drop("block")
    else:
        placed = placed.select("doc_id", "sha", "n_cp", "nb", "pos", *_digest()).join(digests, ["h1", "h2"]).drop("h1", "h2")
    placed = materialise(placed)

    key = ["doc_id", "sha", "n_cp"]
    most = placed.agg(F.max("nb")).first()[0] or 1
    done = [placed.where("nb = 1").groupBy(*key, "name").agg(F.count("*").alias("copies")).select(*key, "copies", F.lit(0).alias("level"), "name")]
    left, level = placed.where("nb > 1").withColumn("copies", F.lit(1).cast("long")), 0
    while 2**level < most:
        even = F.col("pos") % 2 == 0
        copies = F.sum(F.when(even, F.col("copies"))) if level == 0 else F.max("copies")
        pairs = left.groupBy(*key, "nb", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.when(even, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r"), copies.alias("copies"))
        level += 1
        left = materialise(pairs.join(_named(pairs.select("l", "r").distinct(), ["l", "r"]), ["l", "r"]).select(*key, "nb", "pos", "name", "copies"))
        done.append(left.where(F.col("nb") <= 2**level).select(*key, "copies", F.lit(level).alias("level"), "name"))
        left = left.where(F.col("nb") > 2**level)
    return reduce(DataFrame.unionByName, done)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, n_cp``.

    Texts are equal if they are the same without white space. Of equal texts the longest original stays (code points),
    then the smallest id; a null id comes last. A null text counts as empty, so null, empty and blank texts are one
    group. Of rows with the same id and text one is kept and each counts in ``group_size``. An empty table gives an
    empty result. Texts of any length are named by all their blocks. Other columns are not read.
    """
    found = document_names(docs, id_col, text_col, block_bytes)
    best = F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))).alias("best")
    # Written first, so that the join below is a plain one of two exchanges, whose hot groups AQE splits.
    groups = materialise(found.groupBy("level", "name").agg(F.sum("copies").alias("group_size"), best))
    out = found.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    first = (F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n_cp") == -F.col("best.n"))
    return out.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", first.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_cp")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Of rows that repeat id and text the one whose columns are first as JSON stays; they meet in partial aggregates.
    """
    result = materialise(exact_dedup(docs, id_col, text_col).select("doc_id", "kept", "n_cp", "text_sha256"))
    text = F.coalesce(docs[text_col], F.lit(""))
    kept = result.where("kept").select(F.col("doc_id").alias("__id"), F.col("n_cp").alias("__n"), F.col("text_sha256").alias("__sha"))
    same = docs[id_col].eqNullSafe(kept["__id"]) & (F.char_length(text).cast("long") == kept["__n"])
    repeated = materialise(result.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")))
    if repeated.isEmpty():
        return docs.join(kept, same, "left_semi")
    again, row = docs[id_col].eqNullSafe(repeated["__id"]), F.struct(*docs.columns)
    sha = F.sha2(F.regexp_replace(text, f"{SPACE}+", "").cast("binary"), 256)
    few = docs.join(repeated, again, "left_semi").join(kept, same & (sha == kept["__sha"]), "left_semi")
    one = few.groupBy(F.col(id_col).alias("__id"), sha.alias("__sha")).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return docs.join(repeated, again, "left_anti").join(kept, same, "left_semi").unionByName(one)
