"""Repeated word windows across documents, found by backward search in compressed full-text indexes, one per shard.

Windows that could be equal meet in one shard: each window of 13 words has a marker, the least hash of the runs of MARK
words inside it. Consecutive windows with one marker are a region. Regions whose marker only one document has are left
out before any text moves; the distinct texts of the others are indexed, shard by shard, in a Burrows-Wheeler transform over
words, held in a wavelet matrix. The texts then stream through their shard's index.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelf.llm import textbytes as tb
from shelf.llm.skew import join_groups
from shelf.session import spread, write_down

WINDOW = 13
MARK = 5
MOST_WINDOWS = 64
#: A marker that more regions have is crowded: its regions are cut into single windows.
CROWDED = 4096
SHARD_WORDS = 1 << 18
#: Words of an average region: half the places of a marker in a window, and the rest of a window.
REGION_WORDS = (WINDOW - MARK + 2) // 2 + WINDOW - 1
FILTER_BITS = 16
MOST_BITS = 1 << 28
#: Distinct regions that a task holds back to combine equal ones.
COMBINED = 1 << 18
SLICE_BITS = 1 << 19
_WORD = (~tb.WHITE).astype(np.uint8)
_NO_ID = np.iinfo(np.int64).max


def _compact(chunk: tb.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's words with one space between them: bytes, start, end and text number of each word."""
    start, end, text = tb.tokens(chunk.data, chunk.bounds, _WORD)
    sizes = end - start
    new_start = np.cumsum(sizes + 1) - sizes - 1
    data = np.full(int(sizes.sum() + len(sizes)), 0x20, np.uint8)
    inside = np.zeros(len(chunk.data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    gap = np.ones(len(data), bool)
    gap[new_start + sizes] = False
    data[gap] = chunk.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    return data, new_start, new_start + sizes, text


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Regions:
    """The regions of a chunk: marker, text number, first word (in the chunk and in its text), number of windows."""

    def __init__(self, chunk: tb.Chunk):
        self.data, self.start, self.end, text = _compact(chunk)
        self.hash = tb.prefix_hash(self.data)
        n = len(text) - WINDOW + 1
        empty = np.zeros(0, np.int64)
        self.marker, self.text, self.first, self.place, self.windows = np.zeros(0, np.int64), empty, empty, empty, empty
        self.words = np.bincount(text, minlength=len(chunk))
        if n <= 0:
            return
        runs = tb.range_hash(self.hash, self.start[: len(text) - MARK + 1], self.end[MARK - 1 :])
        least = _sliding_least(runs, WINDOW - MARK + 1)
        whole = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
        if not len(whole):
            return
        new = np.ones(len(whole), bool)
        new[1:] = (whole[1:] != whole[:-1] + 1) | (least[whole[1:]] != least[whole[:-1]]) | (text[whole[1:]] != text[whole[:-1]])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(whole)))
        parts = -(-size // MOST_WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        head, size = np.repeat(head, parts) + nth * MOST_WINDOWS, np.minimum(MOST_WINDOWS, np.repeat(size, parts) - nth * MOST_WINDOWS)
        self.first, self.windows = whole[head], size
        self.marker, self.text = least[self.first].view(np.int64), text[self.first]
        self.place = self.first - np.searchsorted(text, self.text)

    def only(self, keep: np.ndarray) -> None:
        for name in ("marker", "text", "first", "place", "windows"):
            setattr(self, name, getattr(self, name)[keep])

    def cut(self, which: np.ndarray) -> None:
        """Regions ``which`` into single windows; the marker of a window is the hash of all its words."""
        times = np.where(which, self.windows, 1)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        single = np.repeat(which, times)
        self.only(np.repeat(np.arange(len(which)), times))
        self.first, self.place = self.first + nth, self.place + nth
        self.windows = np.where(single, 1, self.windows)
        own = tb.mixed(tb.range_hash(self.hash, self.start[self.first], self.end[self.first + WINDOW - 1])).view(np.int64)
        self.marker = np.where(single, own, self.marker)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return self.start[self.first], self.end[self.first + self.windows + WINDOW - 2]


def _markers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column("doc_id"), np.int64)
        for chunk in tb.chunks(batch.column("text")):
            r = Regions(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(r.marker), pa.array(ids[chunk.first + r.text])], ["marker", "doc_id"])


def let_go(spark: SparkSession) -> None:
    """Shuffle files of finished steps are deleted once the driver's objects are collected; have that done now, as the next
    step needs the disk."""
    gc.collect()
    spark._jvm.System.gc()


def _slot(marker: np.ndarray, n_bits: int) -> np.ndarray:
    return (tb.mixed(marker.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(n_bits - 1)).astype(np.int64)


def _slots(n_bits: int) -> object:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _slot(np.asarray(batch.column("marker"), np.int64), n_bits)
            yield pa.RecordBatch.from_arrays([pa.array(at // SLICE_BITS, pa.int32()), pa.array(at % SLICE_BITS, pa.int32())], ["slice", "bit"])

    return place


def _bits(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(SLICE_BITS, bool)
    bits[rows["bit"].to_numpy()] = True
    return pd.DataFrame({"slice": rows["slice"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})


def marker_filter(markers: DataFrame, n: int, most_bits: int = MOST_BITS) -> np.ndarray:
    """A bitmap of hash slots of ``n`` markers, FILTER_BITS for each, at most ``most_bits`` in all (32 MB). Its slices are made in
    tasks. Beyond the bound more regions pass it, and the result stays the same."""
    n_bits = 1 << max(3, int(np.ceil(np.log2(FILTER_BITS * max(1, n)))))
    n_bits = min(most_bits, n_bits)
    out = np.zeros(-(-n_bits // 8), np.uint8)
    slots = markers.select("marker").mapInArrow(_slots(n_bits), "slice int, bit int").distinct()
    for r in slots.groupBy("slice").applyInPandas(_bits, "slice int, bits binary").toLocalIterator():
        piece = np.frombuffer(r["bits"], np.uint8)[: len(out)]
        out[r["slice"] * SLICE_BITS // 8 :][: len(piece)] |= piece
    return out


def in_filter(bits: np.ndarray, marker: np.ndarray) -> np.ndarray:
    at = _slot(marker, 8 * len(bits))
    return bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def _pieces(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges, which may overlap, as an Arrow array of texts."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _passing(chunk: tb.Chunk, repeated: np.ndarray, crowded: np.ndarray) -> tuple[Regions, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's regions that pass the filter, those of crowded markers cut up; their byte ranges and content hashes."""
    r = Regions(chunk)
    r.only(in_filter(repeated, r.marker))
    r.cut(in_filter(crowded, r.marker))
    start, end = r.bounds()
    return r, start, end, tb.range_hash(r.hash, start, end).view(np.int64)


def _occurrences(repeated: object, crowded: object) -> object:
    """Arrow task: where the regions that pass the filter stand, without their texts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = np.asarray(batch.column("doc_id"), np.int64), np.asarray(batch.column("row"), np.int64)
            for chunk in tb.chunks(batch.column("text")):
                r, _, _, content = _passing(chunk, repeated.value, crowded.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.marker), pa.array(content), pa.array(ids[chunk.first + r.text]), pa.array(rows[chunk.first + r.text]), pa.array(r.place, pa.int32())],
                    ["marker", "content", "doc_id", "row", "place"],
                )

    return emit


def _texts(repeated: object, crowded: object) -> object:
    """Arrow task: the distinct regions that pass the filter, each with its words, its smallest and largest doc_id and its
    number of occurrences. Equal regions of a task are one row, up to COMBINED rows at a time."""
    names = ["marker", "content", "words", "first_doc", "last_doc", "n"]

    def combined(parts: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(parts).combine_chunks()
        key = np.stack([whole["marker"].to_numpy(), whole["content"].to_numpy()])
        order = np.lexsort(key)
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(key[:, order]) != 0).any(0)
        at = np.flatnonzero(new)
        sums = [f.reduceat(whole[c].to_numpy()[order], at) for f, c in ((np.minimum, "first_doc"), (np.maximum, "last_doc"), (np.add, "n"))]
        one = whole.select(names[:3]).take(pa.array(order[at]))
        return pa.table([*one.columns, *(pa.array(x) for x in sums)], names=names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"), np.int64)
            for chunk in tb.chunks(batch.column("text")):
                r, start, end, content = _passing(chunk, repeated.value, crowded.value)
                if not len(content):
                    continue
                doc = pa.array(ids[chunk.first + r.text])
                held.append(combined([pa.table([pa.array(r.marker), pa.array(content), _pieces(r.data, start, end), doc, doc, pa.array(np.ones(len(content), np.int64))], names=names)]))
                if sum(t.num_rows for t in held) > COMBINED:
                    held = [combined(held)]
                    if held[0].num_rows > COMBINED // 2:
                        yield from held[0].to_batches(max_chunksize=10_000)
                        held = []
        if held:
            yield from combined(held).to_batches(max_chunksize=10_000)

    return emit


class WaveletMatrix:
    """Symbols 0 to 2**levels - 1 as one packed bit vector per level, with counts before every 64 bits."""

    def __init__(self, symbols: np.ndarray):
        self.n, self.levels = len(symbols), max(1, int(symbols.max(initial=0)).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level & 1).astype(bool)
            words = np.packbits(np.pad(bit, (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def below(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` symbols' last equal one would land in the lowest level; less the same at 0 it is a rank."""
        at = at.copy()
        for k, level in enumerate(reversed(range(self.levels))):
            word = self.bits[k][at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.before[k][at >> 6] + np.bitwise_count(word).astype(np.int64)
            at = np.where(symbol >> level & 1 == 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Full-text index over texts of word numbers from 1 on; 0 ends every text. ``owner`` is each sorted suffix's text.

    ``low`` and ``high`` bound, for every sorted suffix, the suffixes that share its first ``depth`` words: how a match of
    more words is cut at its end."""

    def __init__(self, symbols: np.ndarray, depth: int = WINDOW - 1):
        ends = np.flatnonzero(symbols == 0)
        n, text = len(symbols), np.cumsum(symbols == 0) - (symbols == 0)
        rank = symbols + len(ends)
        rank[ends] = np.arange(len(ends))  # ends differ, so no comparison runs on into the next text
        step, left, shared = 1, depth, np.zeros(n, np.int64)
        while True:
            if left & step:  # the words that ``depth`` still lacks, in stretches of powers of two
                at = np.minimum(np.arange(n) + depth - left, n - 1)
                shared = _paired(shared, rank[at])
                left -= step
            if step >= n or (left <= 0 and rank.max() == n - 1):
                break
            tail = np.zeros(n, np.int64)
            tail[: n - step] = rank[step:] + 1
            rank = _paired(rank, tail)
            step *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self.owner = text[order]
        self.matrix = WaveletMatrix(symbols[order - 1])
        counts = np.bincount(symbols)
        self.shift = np.cumsum(counts) - counts - self.matrix.below(np.arange(len(counts)), np.zeros(len(counts), np.int64))
        new = np.ones(n + 1, bool)
        new[1:-1] = shared[order][1:] != shared[order][:-1]
        edges = np.flatnonzero(new)
        group = np.cumsum(new[:-1]) - 1
        self.low, self.high = edges[group], edges[group + 1]

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: suffix ranges of the matches with ``symbol`` before them."""
        both = self.matrix.below(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.shift[symbol], 2)
        return both[: len(low)], both[len(low) :]


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (a, b)."""
    key = a * (int(b.max(initial=0)) + 1) + b
    order = np.argsort(key)
    new = np.zeros(len(key), np.int64)
    new[1:] = key[order][1:] != key[order][:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def long_matches(symbols: np.ndarray, threshold: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, FMIndex]:
    """Matching statistics of every text against the index of all of them, as far as ``threshold``.

    All texts stream through the index from their ends: the last words are searched backwards, then every word to the left is
    one more step, before which the match is cut to ``threshold`` - 1 words. Returns the places whose match reaches the
    threshold and is not the place's own alone, and the suffix range [low, high) of each."""
    index = FMIndex(symbols, threshold - 1)
    ends = np.flatnonzero(symbols == 0)
    sizes = np.diff(ends, prepend=-1) - 1
    at = ends[sizes >= threshold]
    first = at - sizes[sizes >= threshold]
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(symbols), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    length = 0
    while len(at):
        at = at - 1
        low, high = index.extended(symbols[at], low, high)
        length += 1
        if length < threshold:
            continue
        several = high - low > 1
        found.append((at[several], low[several], high[several]))
        on = at > first
        at, first, row = at[on], first[on], low[on]
        low, high = index.low[row], index.high[row]
    return *(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (list(zip(*found)) or [()] * 3)), index


def _earliest(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: index its texts, stream them through, and say for every window which document has it first."""
    same = rows.groupby(["marker", "content"], sort=False)
    rows = same.agg(words=("words", "first"), first_doc=("first_doc", "min"), last_doc=("last_doc", "max"), n=("n", "sum")).reset_index()
    own = rows["first_doc"].to_numpy()
    split = [w.split(b" ") for w in rows["words"]]
    sizes = np.array([len(w) for w in split])
    words = pa.array([x for w in split for x in w], pa.large_binary())
    head = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(len(words) + len(split), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[head + sizes] = False
    symbols[inside] = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    text = np.repeat(np.arange(len(split)), sizes + 1)
    least = own[text].copy()
    at, low, high, index = long_matches(symbols)
    if len(at):
        starts, nth, which = np.unique(low, return_index=True, return_inverse=True)  # ranges of equal length are equal or apart
        docs = np.append(own[index.owner], _NO_ID)
        least[at] = np.minimum.reduceat(docs, np.stack([starts, high[nth]], 1).ravel())[::2][which]
    keep = np.arange(len(symbols)) - head[text] <= sizes[text] - WINDOW
    lists = np.split(least[keep], np.cumsum(sizes - WINDOW + 1)[:-1])
    out = rows[["marker", "content", "n"]].assign(least=lists)
    return out[[bool((x < last).any()) for x, last in zip(lists, rows["last_doc"])]]


def earliest_windows(texts: DataFrame, shards: int) -> DataFrame:
    """Written (marker, content, n, least): for every distinct region that some document must cut, the smallest doc_id that
    has each of its windows. Regions of one marker are in one shard."""
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("marker"), F.lit(shards)))
    return write_down(spread(dealt, "shard").groupBy("shard").applyInPandas(_earliest, "marker long, content long, n long, least array<long>"), "earliest")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word ranges that a region's windows of smaller doc_ids cover, as pairs of one list per region."""
    for batch in batches:
        ids, place = np.asarray(batch.column("doc_id"), np.int64), np.asarray(batch.column("place"), np.int64)
        lists = batch.column("least")
        size = np.asarray(lists.value_lengths(), np.int64)
        row = np.repeat(np.arange(len(batch)), size)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        hit = np.asarray(lists.flatten(), np.int64) < ids[row]
        row, at = row[hit], place[row[hit]] + nth[hit]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + WINDOW)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row))[: len(first)] - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[row[first]]), batch.column("row").take(pa.array(row[first])), pa.array(at[first], pa.int32()), pa.array(at[last] + WINDOW, pa.int32())], ["doc_id", "row", "start", "end"]
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
            raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)
            data, start, end, _ = _compact(tb.Chunk(0, 1, raw, np.array([0, len(raw)])))
            gone = np.zeros(len(start) + 1, np.int64)
            for s in spans or ():
                gone[s["start"]] += 1
                gone[s["end"]] -= 1
            covered = np.cumsum(gone)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[True], covered, [True]]).astype(np.int8)))
            kept = b" ".join(data[start[a] : end[b - 1]].tobytes() for a, b in zip(edges[::2], edges[1::2]))
            a = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
            removed = [{"start": x, "end": y} for x, y in zip(a[::2].tolist(), a[1::2].tolist())]
            out.append((len(start), int(covered.sum()), hashlib.sha256(kept).hexdigest(), removed))
        n, gone, sha, removed = zip(*out) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"],
        )


def remove_shared_windows(docs: DataFrame, crowded: int = CROWDED, shard_words: int = SHARD_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) of every row; ``removed`` has the maximal runs as word places.

    A word goes if a window of 13 words covers it whose words also start in a document of a smaller doc_id; doc_id must be
    an integer. Null counts as a text without words; texts of fewer than 13 words lose nothing. Texts of any length are
    taken whole. A null doc_id is larger than all others, so such rows lose what any numbered document has and nothing
    else. Rows that repeat a doc_id are judged one by one against smaller doc_ids, also where their texts differ. An empty
    table gives no rows. Other columns are not looked at.

    Markers that very many regions have (a passage of a third of all documents) are cut into single windows, of which
    equal ones are one row, so no shard grows with a marker's documents.
    """
    spark = docs.sparkSession
    number = F.col("doc_id").cast("long")
    texts = docs.select(number.alias("doc_id"), "text", F.coalesce(number, F.lit(_NO_ID)).alias("order"), F.xxhash64("text").alias("row"))
    ordered = texts.select(F.col("order").alias("doc_id"), "row", "text")
    per_marker = ordered.select("doc_id", "text").mapInArrow(_markers, "marker long, doc_id long").groupBy("marker").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"))
    repeated = write_down(per_marker.filter("a < b").select("marker", "n"), "markers")
    many = repeated.filter(F.col("n") > crowded)
    size = repeated.agg(F.count("*").alias("markers"), F.count_if(F.col("n") > crowded).alias("many"), F.sum("n").alias("regions")).first()
    sent = [spark.sparkContext.broadcast(marker_filter(x, n, most_bits)) for x, n in ((repeated, size["markers"]), (many, size["many"]))]
    let_go(spark)
    found = write_down(ordered.mapInArrow(_occurrences(*sent), "marker long, content long, doc_id long, row long, place int"), "found")
    distinct = ordered.select("doc_id", "text").mapInArrow(_texts(*sent), "marker long, content long, words binary, first_doc long, last_doc long, n long")
    earliest = earliest_windows(distinct, max(1, (size["regions"] or 0) * REGION_WORDS // shard_words))
    let_go(spark)
    hits = join_groups(found, earliest, ["marker", "content"], "n", size["regions"] or 0)
    spans = hits.select("doc_id", "row", "place", "least").mapInArrow(_spans, "doc_id long, row long, start int, end int")
    spans = write_down(spans.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnRenamed("doc_id", "order"), "spans")
    let_go(spark)
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    return texts.join(spans, ["order", "row"], "left").select("doc_id", "text", "spans").mapInArrow(_kept, result)
