"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents of like length. A block is a bit matrix: a column per document, a row per hash place.
A key (a term, or a term with a number of occurrences that the document exceeds) sets HASHES places of its document's
column, so the bitmaps of a key's rows, taken together, show every document that has the key, and now and then one more.
Weighted sums of these bitmaps are upper bounds of scores. Documents whose bound cannot enter an item's best are excluded,
all others are scored from their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from shelf.llm import textbytes as tb
from shelf.llm.skew import SMALL_ROWS, perhaps_in
from shelf.session import write_down

BEST = 10
HASHES = 3
BITS_PER_KEY = 10
BLOCK_DOCS = 1024
#: A block is closed when its keys reach this number, whatever its documents.
BLOCK_KEYS = 1 << 20
#: Keys of a term that occurs more than 0, 1, 2, 4, 8 and 16 times.
LEVELS = np.array([0, 1, 2, 4, 8, 16])
ITEM_BYTES = 1 << 20
#: Cells of a bound matrix that are held at a time.
CELLS = 1 << 22
_TERM = np.zeros(256, np.uint8)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_LEVEL_HASH = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, len(LEVELS), dtype=np.uint64)
_PLACE_HASH = np.random.Generator(np.random.PCG64(13)).integers(1, 1 << 63, HASHES, dtype=np.uint64)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 25 + (75 * n * n_docs) // n_terms


def gain(tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    """What one occurrence of weight 1 in the item adds; it grows with tf and stays under 1,000,000."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _terms(chunk: tb.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = tb.LOWER[chunk.data]
    return data, *tb.tokens(data, chunk.bounds, _TERM)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow array; they must be in order and apart."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    packed = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])


def key_hashes(term: np.ndarray, level: np.ndarray) -> np.ndarray:
    return tb.mixed(term ^ _LEVEL_HASH[level])


def places(keys: np.ndarray, n_rows: int) -> np.ndarray:
    """[key, HASHES] rows of a block with ``n_rows`` (a power of two) rows."""
    return (tb.mixed(keys[:, None] ^ _PLACE_HASH[None]) & np.uint64(n_rows - 1)).astype(np.int64)


class _OpenBlock:
    """Documents of one length class that wait for their block to fill."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.keys: list[np.ndarray] = []
        self.n_keys = 0

    def close(self) -> tuple[list[int | None], list[int], int, bytes]:
        most = max(len(k) for k in self.keys)
        n_rows = 1 << max(6, math.ceil(math.log2(BITS_PER_KEY * max(1, most))))
        n = len(self.ids)
        at = places(np.concatenate(self.keys), n_rows).ravel()
        doc = np.repeat(np.arange(n), [HASHES * len(k) for k in self.keys])
        bits = np.zeros((n_rows, -(-n // 8)), np.uint8)
        np.bitwise_or.at(bits, (at, doc >> 3), np.uint8(128) >> (doc & 7).astype(np.uint8))
        return self.ids, self.lengths, n_rows, bits.tobytes()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_blocks: dict[int, _OpenBlock] = {}

    def closed(block: _OpenBlock) -> pa.RecordBatch:
        ids, lengths, n_rows, bits = block.close()
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([n_rows], pa.int32()), pa.array([bits], pa.binary())], ["doc_ids", "lengths", "n_rows", "bits"]
        )

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for chunk in tb.chunks(batch.column("text")):
            data, start, end, text = _terms(chunk)
            term = tb.range_hash(tb.prefix_hash(data), start, end)
            order = np.lexsort((term, text))
            term, text = term[order], text[order]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            tf = np.diff(np.append(at, len(term)))
            n_levels = np.searchsorted(LEVELS, tf, "left")
            which = np.repeat(np.arange(len(at)), n_levels)
            level = np.arange(len(which)) - np.repeat(np.cumsum(n_levels) - n_levels, n_levels)
            keys, owner = key_hashes(term[at][which], level), text[at][which]
            first = np.searchsorted(owner, np.arange(len(chunk) + 1))
            n_terms = np.bincount(text, minlength=len(chunk))
            for k in np.flatnonzero(n_terms).tolist():
                mine = keys[first[k] : first[k + 1]]
                size = int(len(mine)).bit_length()
                block = open_blocks.setdefault(size, _OpenBlock())
                block.ids.append(ids[chunk.first + k]), block.lengths.append(int(n_terms[k])), block.keys.append(mine.copy())
                block.n_keys += len(mine)
                if len(block.ids) >= BLOCK_DOCS or block.n_keys >= BLOCK_KEYS:
                    yield closed(open_blocks.pop(size))
    for block in open_blocks.values():
        yield closed(block)


def build_index(docs: DataFrame) -> DataFrame:
    """Written blocks (doc_ids, lengths, n_rows, bits) over every document with a term; no rows shuffle."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return write_down(texts.mapInArrow(_index, "doc_ids array<long>, lengths array<long>, n_rows int, bits binary"), "signatures")


def item_terms(texts: list[str | None]) -> list[dict[bytes, int]]:
    """Terms of each item with their repeats."""
    found: list[dict[bytes, int]] = [{} for _ in texts]
    for chunk in tb.chunks(pa.array(texts, pa.string())):
        data, start, end, text = _terms(chunk)
        for a, b, k in zip(start.tolist(), end.tolist(), text.tolist()):
            word = data[a:b].tobytes()
            found[chunk.first + k][word] = found[chunk.first + k].get(word, 0) + 1
    return found


class Query:
    """Items of one block: their vocabulary, and repeats of its terms as item, term, times."""

    def __init__(self, item_ids: list[object], texts: list[str | None]):
        self.item_ids, words = item_ids, item_terms(texts)
        self.vocabulary = sorted({w for d in words for w in d})
        number = {w: k for k, w in enumerate(self.vocabulary)}
        rows = [(i, number[w], n) for i, d in enumerate(words) for w, n in sorted(d.items())]
        self.item, self.term, self.times = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        data = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in self.vocabulary], dtype=np.int64)
        self.hashes = tb.range_hash(tb.prefix_hash(data), ends - [len(w) for w in self.vocabulary], ends) if rows else np.zeros(0, np.uint64)
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        self.weights = np.array([term_weight(n_docs, df.get(k, 0)) for k in range(len(self.vocabulary))], np.int64)


def _count_terms(query: Query) -> object:
    """Arrow task: how many documents hold each term of the vocabulary, by the terms' bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, words = np.zeros(len(query.vocabulary), np.int64), pa.array(query.vocabulary, pa.large_binary())
        for batch in batches:
            for chunk in tb.chunks(batch.column("text")):
                data, start, end, text = _terms(chunk)
                found = pc.fill_null(pc.index_in(_strings(data, start, end), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                pairs = np.unique(text[found >= 0] * len(df) + found[found >= 0])
                df += np.bincount(pairs % len(df), minlength=len(df)) if len(df) else 0
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(df[there], pa.int64())], ["term", "df"])

    return count


def upper_bounds(query: Query, bits: np.ndarray, m: np.ndarray) -> np.ndarray:
    """[item, document] bounds of a block [n_rows, bytes]: per term the highest level whose rows all show the document
    says how often it can occur there at most; the gains are summed with the items' weights."""
    bounds = np.zeros((len(query.item_ids), len(m)), np.int64)
    step = max(1, CELLS // max(1, len(query.item)) // 8)
    for a in range(0, bits.shape[1], step):
        _slice_bounds(query, bits[:, a : a + step], m[8 * a : 8 * (a + step)], bounds[:, 8 * a : 8 * (a + step)])
    return bounds


def _slice_bounds(query: Query, bits: np.ndarray, m: np.ndarray, bounds: np.ndarray) -> None:
    n, n_terms = len(m), len(query.vocabulary)
    gains = np.stack([gain(int(t), m) for t in LEVELS[1:]] + [np.full(n, 1_000_000, np.int64)])
    value, live = np.zeros((n_terms, n), np.int64), np.arange(n_terms)
    shown = np.full((n_terms, bits.shape[1]), 255, np.uint8)
    for level in range(len(LEVELS)):
        at = places(key_hashes(query.hashes[live], np.full(len(live), level)), len(bits))
        there = shown[live]
        for h in range(HASHES):
            there = there & bits[at[:, h]]
        shown[live] = there
        some = there.any(1)
        live = live[some]
        if not len(live):
            break
        t, d = np.nonzero(np.unpackbits(there[some], axis=1, count=n))
        value[live[t], d] = gains[level][d]
    value *= query.weights[:, None]
    at = np.flatnonzero(np.diff(query.item, prepend=-1))
    bounds[query.item[at]] = np.add.reduceat(value[query.term] * query.times[:, None], at, 0)


def _blocks(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, null ids as the largest number; bits; length norms) of every block."""
    for batch in batches:
        for k in range(len(batch)):
            ids = batch.column("doc_ids")[k].values
            ids = np.asarray(pc.fill_null(ids, np.iinfo(np.int64).max), np.int64)
            bits = np.frombuffer(batch.column("bits")[k].as_buffer(), np.uint8).reshape(batch.column("n_rows")[k].as_py(), -1)
            yield ids, bits, length_norm(np.asarray(batch.column("lengths")[k].values, np.int64), n_docs, n_terms)


_PAIRS = "item int, doc_id long, bound long"


def _pairs(item: np.ndarray, ids: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64()), pa.array(bound, pa.int64())], ["item", "doc_id", "bound"])


def _highest(query: Query, n_docs: int, n_terms: int, k: int) -> object:
    """Arrow task: its ``k`` documents of the highest bounds for each item, equal bounds by doc_id."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_bound, best_id = np.zeros((len(query.item_ids), 0), np.int64), np.zeros((len(query.item_ids), 0), np.int64)
        for ids, bits, m in _blocks(batches, n_docs, n_terms):
            best_bound = np.concatenate([best_bound, upper_bounds(query, bits, m)], 1)
            best_id = np.concatenate([best_id, np.broadcast_to(ids, (len(best_id), len(ids)))], 1)
            order = np.lexsort((best_id, -best_bound), axis=1)[:, :k]
            best_bound, best_id = np.take_along_axis(best_bound, order, 1), np.take_along_axis(best_id, order, 1)
        item, place = np.nonzero(best_bound)
        yield _pairs(item, best_id[item, place], best_bound[item, place])

    return walk


def _not_excluded(query: Query, n_docs: int, n_terms: int, least: np.ndarray, last: np.ndarray) -> object:
    """Arrow task: pairs whose bound passes the item's threshold, or meets it with a doc_id not over the threshold's."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bits, m in _blocks(batches, n_docs, n_terms):
            bounds = upper_bounds(query, bits, m)
            item, doc = np.nonzero((bounds > least[:, None]) | ((bounds == least[:, None]) & (ids[None] <= last[:, None]) & (bounds > 0)))
            yield _pairs(item, ids[doc], bounds[item, doc])

    return walk


def _score(query: Query, n_docs: int, n_terms: int) -> object:
    """Arrow task: exact scores of texts for the items asked for, by the terms' bytes."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(query.vocabulary, pa.large_binary())
        edges = np.searchsorted(query.item, np.arange(len(query.item_ids) + 1))
        for batch in batches:
            asked = batch.column("items").to_pylist()
            out: list[tuple[int, int, int]] = []
            for chunk in tb.chunks(batch.column("text")):
                data, start, end, text = _terms(chunk)
                found = pc.fill_null(pc.index_in(_strings(data, start, end), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                m = length_norm(np.bincount(text, minlength=len(chunk)), n_docs, n_terms)
                first = np.searchsorted(text, np.arange(len(chunk) + 1))
                for k in range(len(chunk)):
                    mine = found[first[k] : first[k + 1]]
                    tf = np.bincount(mine[mine >= 0], minlength=len(words))
                    value = query.weights * np.where(tf > 0, gain(tf, m[k]), 0)
                    for item in asked[chunk.first + k]:
                        a, b = edges[item], edges[item + 1]
                        out.append((item, chunk.first + k, int((value[query.term[a:b]] * query.times[a:b]).sum())))
            item, row, score = (np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch.column("doc_id").take(pa.array(row)), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return walk


def _exact(docs: DataFrame, pairs: DataFrame, query: Query, n_docs: int, n_terms: int) -> DataFrame:
    """Written (item, doc_id, score > 0) of the pairs; every row with such a doc_id is scored, each once."""
    id_key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    asked = write_down(pairs.groupBy("doc_id").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumnRenamed("doc_id", "_key"), "asked")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", id_key.alias("_key"))
    few = (asked.agg(F.sum(F.size("items") + 4)).first()[0] or 0) <= 10 * SMALL_ROWS
    joined = texts.join(F.broadcast(asked), "_key") if few else perhaps_in(texts, asked, "_key").join(asked, "_key")
    scored = joined.select("doc_id", "text", "items").mapInArrow(_score(query, n_docs, n_terms), "item int, doc_id long, score long")
    return write_down(scored.filter("score > 0"), "scores")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(index: DataFrame, docs: DataFrame, query: Query, n_docs: int, n_terms: int, k: int = BEST) -> DataFrame:
    """(item, rank, doc_id, score) for one block of items: the documents of the highest bounds are scored first, the k-th
    score found is the threshold, then every document that its bound does not exclude is scored."""
    df = {r["term"]: r["df"] for r in docs.select("text").mapInArrow(_count_terms(query), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    query.weigh(n_docs, df)
    high = index.mapInArrow(_highest(query, n_docs, n_terms, k), _PAIRS)
    order = W.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
    seeds = _exact(docs, high.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k), query, n_docs, n_terms)
    least, last = np.zeros(len(query.item_ids), np.int64), np.full(len(query.item_ids), np.iinfo(np.int64).max)
    for r in _ranked(seeds, k).filter(F.col("rank") == k).collect():
        least[r["item"]], last[r["item"]] = r["score"], np.iinfo(np.int64).max if r["doc_id"] is None else r["doc_id"]
    pairs = index.mapInArrow(_not_excluded(query, n_docs, n_terms, least, last), _PAIRS)
    return _ranked(_exact(docs, pairs, query, n_docs, n_terms), k).select("item", "rank", "doc_id", "score")


def item_blocks(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """Items one block after the other, each of at most ``limit`` bytes of text (one item at least); only one block is in
    the driver at a time."""
    block, size = [], 0
    for r in items.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        more = len((r["text"] or "").encode())
        if block and size + more > limit:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += more
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = BEST, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` documents of the highest scores above 0 for every item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased; scores are integers, see
    the formulas above. Equal scores go by doc_id, null last. Null or termless texts and items have no rows. Texts of any
    length count whole. Rows that repeat a doc_id are documents of their own. Repeated rows of ``items`` count once; rows with
    one item_id and different texts are ranked one by one. Empty tables give no rows. Other columns are not looked at.

    Items are searched in blocks of bounded size, each in four passes: document frequencies, bounds, first scores, all
    scores that the bounds do not exclude.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    index = build_index(docs)
    total = index.select(F.size("doc_ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not n_docs:
        return found
    for block in item_blocks(items, item_bytes):
        query = Query([i for i, _ in block], [t for _, t in block])
        if not query.vocabulary:
            continue
        names = spark.createDataFrame(list(enumerate(query.item_ids)), f"item int, item_id {kind}")
        rows = search_block(index, docs, query, n_docs, n_terms, k)
        found = found.unionByName(write_down(rows.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
    return found
