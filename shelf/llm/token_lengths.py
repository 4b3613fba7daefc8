"""Token counts: the exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from shelf.session import write_down

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's own tokenizer splits a text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1024
_encoders: dict[tuple[int, int], object] = {}


def _encoder(vocabulary: bytes, pattern: str):
    key = (hash(vocabulary), hash(pattern))
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens): tokens of every whole text; null and empty texts have 0. The driver reads the
    vocabulary file (about 1 MB) and sends it to the tasks."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): documents of each length that occurs; tasks send one row for each of their lengths."""
    return lengths.filter("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Totals for every length that occurs, as context limit:

    tokens, docs_longer and tokens_longer (documents above it, and their tokens), tokens_cut (all tokens when
    every document is cut to it), docs_share (share of documents at or below it). Sums run within blocks of
    ``BLOCK`` lengths first, so that only one row per block meets in one task. Empty for an empty histogram.
    """
    h = write_down(histogram, "histogram").withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / BLOCK)})
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(everything).alias("d_all"), F.sum("t").over(everything).alias("t_all"),
    )
    longer = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    return (
        h.join(blocks, "block")
        .withColumns({
            "docs_longer": F.col("d_above") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0)),
            "tokens_longer": F.col("t_above") + F.coalesce(F.sum("tokens").over(longer), F.lit(0)),
        })
        .select(
            "n_tokens", "n_docs", "tokens", "docs_longer", "tokens_longer",
            (F.col("t_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("tokens_cut"),
            ((F.col("d_all") - F.col("docs_longer")) / F.col("d_all")).alias("docs_share"),
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_longer, tokens_cut) for any limits >= 0, also between the lengths that occur. One
    aggregate answers all of them."""
    wanted = sorted({int(x) for x in limits})
    n = F.col("n_tokens")
    totals = [
        F.struct(
            F.lit(x).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(n > x, F.col("n_docs"))), F.lit(0)).alias("docs_longer"),
            F.coalesce(F.sum(F.least(n, F.lit(x)) * F.col("n_docs")), F.lit(0)).alias("tokens_cut"),
        )
        for x in wanted
    ]
    return sums.agg(F.array(*totals).alias("a")).select(F.inline("a"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length at or below which at least this share of the documents lies."""
    wanted = sums.sparkSession.createDataFrame([(float(x),) for x in sorted(set(shares))], "share double")
    return sums.join(F.broadcast(wanted), F.col("docs_share") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
