"""Exact deduplication with a two-pass Bloom filter. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelf.llm.skew import join_groups
from shelf.session import write_down

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_ROW = 16
MAX_WORDS = 1 << 20


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed. Texts of ASCII alone take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def with_bits(hashed: DataFrame, n_rows: int, max_words: int = MAX_WORDS) -> DataFrame:
    """Adds where a digest stands in the blocked Bloom filter: one 64-bit word, and four bits in it."""
    n_words = min(max_words, max(64, n_rows * BITS_PER_ROW // 64))
    h = F.xxhash64("text_sha256")
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(4)]
    bits = bit[0].bitwiseOR(bit[1]).bitwiseOR(bit[2]).bitwiseOR(bit[3])
    return hashed.withColumns({"word": F.pmod(F.xxhash64("text_sha256", F.lit(1)), F.lit(n_words)), "bits": bits})


def bloom_words(hashed: DataFrame, n_rows: int, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """First pass: ``hashed`` with its places, and the filter (word, seen) of the bits set by more than one row.
    The build shuffles one (word, bits) pair of practically every distinct row.

    The filter grows with the rows up to ``max_words`` words, which bounds its size; beyond that more rows pass
    it, and the result stays the same."""
    placed = with_bits(hashed, n_rows, max_words)
    again = placed.groupBy("word", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    return placed, again.groupBy("word").agg(F.bit_or("bits").alias("seen"))


def probed(placed: DataFrame, seen: DataFrame) -> DataFrame:
    """Second pass: ``placed`` with ``maybe``, false for digests that surely occur once. The filter has at most
    MAX_WORDS rows of two longs and is broadcast."""
    there = F.col("bits").bitwiseAND(F.col("seen")) == F.col("bits")
    return placed.join(F.broadcast(seen), "word", "left").withColumn("maybe", F.coalesce(there, F.lit(False))).drop("word", "bits", "seen")


def exact_groups(docs: DataFrame, carry: tuple[str, ...] = (), max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, ``carry``..., keep_id, group_size, kept, text_sha256) of every row.

    The second pass probes the filter. A row whose bits are not all there occurs once and passes straight
    through, with what it carries; only the others shuffle, by digest. Digests of large groups, few by their
    size, are broadcast instead, and their rows stay where they are.

    Texts are equal when they are identical after lower-casing A-Z; of equal texts the row with the largest
    doc_id stays. Null text counts as empty. A row without doc_id is a row like any other: it stays only if its
    group has no doc_id at all. Rows that repeat a doc_id and a text share their fate.
    """
    taken = [c for c in carry if c != "doc_id"]
    hashed = write_down(docs.select("doc_id", digest(F.col("text")).alias("text_sha256")), "digests")
    n = hashed.count()
    placed, seen = bloom_words(hashed, n, max_words)
    seen = write_down(seen, "bloom")
    groups = write_down(
        probed(placed, seen).filter("maybe").groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1"), "groups"
    )
    rows = probed(with_bits(docs.select("doc_id", *taken, digest(F.col("text")).alias("text_sha256")), n, max_words) if taken else placed, seen)
    columns = ["doc_id", *taken, "keep_id", "group_size", "text_sha256"]
    again = join_groups(rows.filter("maybe"), groups, "text_sha256", "group_size", n, "left")
    again = again.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1))})
    every = rows.filter("not maybe").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}).select(columns).unionByName(again.select(columns))
    return every.select("doc_id", *taken, "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def kept_rows(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names: they travel as one."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"))
    kept = exact_groups(packed, ("row",), max_words).filter("kept")
    return kept.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
