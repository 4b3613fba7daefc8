"""Removal of repeated passages with run-length indexes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from shelf.llm import textbytes as tb
from shelf.llm.skew import SLOTS, perhaps_in
from shelf.session import spread, write_down

MATCH = 100
GRAM = 24
INDEX_BYTES = 1 << 20
GROUP_ROWS = 50_000
_END = 0xFF  # never a byte of UTF-8
_TOP = np.uint64(0xFFFFFFFF00000000)


def regions(chunk: tb.Chunk, match: int = MATCH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Every ``match``-byte window of a chunk's texts belongs to its smallest ``gram``-byte hash (leftmost of equal
    ones), which depends on the window alone. Runs of windows that belong to one place are a region: text number,
    first window (place in the text), number of windows less one, the hash they belong to, and a hash of the bytes."""
    data, bounds = chunk.data, chunk.bounds
    n, width = len(data), match - gram + 1
    if n < match:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    h = tb.prefix_hash(data)
    grams = n - gram + 1
    g = tb.mixed((h[gram:] - h[:-gram]) * tb.powers(n + 1)[1][:grams])
    v = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max, np.uint64)
    v[:grams] = (g & _TOP) | np.arange(grams, dtype=np.uint64)
    rows = v.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - match + 1
    place = np.minimum(after[:windows], before[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFFFF)
    valid = np.zeros(windows + 1, np.int8)
    lengths = np.diff(bounds)
    long = lengths >= match
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, bounds[:-1][long] + lengths[long] - match + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    new = np.ones(windows, bool)
    new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    first_of_text = bounds[:-1][long]
    new[first_of_text] = True
    at = np.flatnonzero(new | ~valid)
    last = np.append(at[1:], windows) - 1
    at, last = at[valid[at]], last[valid[at]]
    text = np.searchsorted(bounds, at, "right") - 1
    return text, at - bounds[text], last - at, g[place[at].astype(np.int64)], tb.range_hash(h, at, last + match)


def find_regions(docs: DataFrame) -> DataFrame:
    """(sure, m, f, doc_id, first, more) of all regions. A region that an earlier one of the same batch equals is
    surely a repeat (m is then only there to spread the rows); so a frequent passage leaves a task once a batch."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            parts = [(chunk.first, regions(chunk)) for chunk in tb.chunks(batch.column("text"))]
            if not parts:
                continue
            doc = ids[np.concatenate([first + r[0] for first, r in parts])]
            first, more, m, f = (np.concatenate([r[k] for _, r in parts]) for k in range(1, 5))
            order = np.lexsort((first, doc, f))
            d, s, x = doc[order], first[order], f[order]
            head = np.maximum.accumulate(np.where(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)], np.arange(len(x)), 0))
            sure = np.zeros(len(x), bool)
            sure[order] = (d != d[head]) | (s != s[head])
            m = np.where(sure, tb.mixed(f + doc.astype(np.uint64) * np.uint64(3) + first.astype(np.uint64)), m)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sure), pa.array(m.view(np.int64)), pa.array(f.view(np.int64)), pa.array(doc), pa.array(first.astype(np.int32)), pa.array(more.astype(np.int16))],
                ["sure", "m", "f", "doc_id", "first", "more"],
            )

    return docs.select("doc_id", "text").filter(F.octet_length("text") >= MATCH).mapInArrow(
        find, "sure boolean, m long, f long, doc_id long, first int, more short"
    )


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of strings in order, each closed by an end mark.

    Kept are the runs (first rank and byte) and samples at run ends: for the first suffix of each run its place in
    the text, the place of the suffix sorted before it, and how many bytes the two share."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        codes = np.append(text, np.full(8, _END, np.uint8)).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key |= codes[j : j + n] << np.uint64(56 - 8 * j)
        ranks, length = [], 8
        while True:
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            ranks.append((length, rank))
            if rank[order[-1]] == n or length >= n:
                break
            shifted = np.full(n, n + 1)  # past the end sorts last, as an end mark does
            shifted[:-length] = rank[length:]
            key = rank.astype(np.uint64) * np.uint64(n + 2) + shifted.astype(np.uint64)
            length *= 2
        before = text[order - 1].astype(np.int16)  # the transform; nothing stands before the first place
        before[order == 0] = 256
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.run_start, self.run_byte, self.n = head, before[head], n
        place, previous = order[head], order[np.maximum(head, 1) - 1]
        shared = np.zeros(len(head), np.int64)
        for step, r in reversed(ranks):
            a, b = place + shared, previous + shared
            inside = (a < n) & (b < n)
            shared += np.where(inside & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)]), step, 0)
        for _ in range(7):
            a, b = place + shared, previous + shared
            inside = (a < n) & (b < n)
            shared += inside & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
        shared[head == 0] = 0
        by_place = np.argsort(place)
        self.place, self.previous, self.shared = place[by_place], previous[by_place], shared[by_place]

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place of the text, streamed from the samples: the length of its match with the suffix sorted before
        it, and where that starts. Between two samples the match loses one byte and moves on by one at each place."""
        at = np.arange(self.n)
        sample = np.searchsorted(self.place, at, "right") - 1
        on = at - self.place[sample]
        return np.maximum(self.shared[sample] - on, 0), self.previous[sample] + on


def repeated_windows(text: np.ndarray, ends: np.ndarray, match: int = MATCH) -> np.ndarray:
    """For strings in ``text`` (each closed by an end mark; ``ends``: where the marks stand): True at every place whose
    ``match`` bytes lie within a string and also start at a smaller place."""
    length, source = RunIndex(text).matching_statistics()
    at = np.arange(len(text))
    room = ends[np.searchsorted(ends, at)] - at
    linked = (length >= match) & (room >= match)
    head = np.where(linked, source, at)
    while True:  # along matches to the first suffix of each class, in steps that double
        further = head[head]
        if np.array_equal(further, head):
            break
        head = further
    least = at.copy()
    np.minimum.at(least, head, at)
    return (least[head] < at) & (room >= match)


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def mark_repeats(contents: DataFrame) -> DataFrame:
    """(doc_id, start, end): bytes of different regions that share their hash ``m`` and are covered by windows that
    also start in an earlier region. Whole groups of one ``m`` are indexed together, up to INDEX_BYTES or one group."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(rows: list) -> pa.RecordBatch:
            text = np.frombuffer(b"".join(r[3] + b"\xff" for r in rows), np.uint8)
            ends = np.cumsum([len(r[3]) + 1 for r in rows]) - 1
            a, b = _runs(repeated_windows(text, ends))
            which = np.searchsorted(ends, a)
            zero = np.append(0, ends[:-1] + 1)[which]
            doc, first = (np.array([r[k] for r in rows], np.int64)[which] for k in (1, 2))
            return pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(first + a - zero), pa.array(first + b - zero - 1 + MATCH)], ["doc_id", "start", "end"]
            )

        rows, size = [], 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("m", "doc_id", "first", "content"))):
                if rows and rows[-1][0] != r[0] and size >= INDEX_BYTES:
                    yield marked(rows)
                    rows, size = [], 0
                if not rows or rows[-1][:3] != r[:3]:  # a repeated row is one text
                    rows.append(r)
                    size += len(r[3])
        if rows:
            yield marked(rows)

    rows = spread(contents, "m").sortWithinPartitions("m", "doc_id", "first")
    return rows.select("m", "doc_id", "first", "content").mapInArrow(mark, "doc_id long, start long, end long")


def mark_crowded(contents: DataFrame) -> DataFrame:
    """As :func:`mark_repeats`, for groups too large for one index: a row for each window, ranked by its digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, digest = [], [], []
            for d, s, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "content"))):
                for k in range(len(x) - MATCH + 1):
                    doc.append(d), start.append(s + k), digest.append(hashlib.blake2b(x[k : k + MATCH], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(digest, pa.binary())], ["doc_id", "start", "digest"])

    windows = contents.select("doc_id", "first", "content").mapInArrow(cut, "doc_id long, start long, digest binary")
    least = write_down(windows.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("least"), F.count("*").alias("n")).filter("n > 1"), "least")
    again = windows.join(least, "digest").filter("struct(doc_id, start) > least")
    return again.select("doc_id", "start", (F.col("start") + MATCH).alias("end")).distinct()


def _cut_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m, doc, first, content, crowded = [], [], [], [], []
        for d, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
            raw = text.as_buffer() if hasattr(text, "as_buffer") else text.as_py().encode()
            raw = bytes(raw)
            for w in wanted:
                m.append(w["m"]), doc.append(d), first.append(w["first"]), crowded.append(w["crowded"])
                content.append(raw[w["first"] : w["first"] + w["more"] + MATCH])
        yield pa.RecordBatch.from_arrays(
            [pa.array(m, pa.int64()), pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(crowded, pa.bool_()), pa.array(content, pa.binary())],
            ["m", "doc_id", "first", "crowded", "content"],
        )


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            raw = bytes(text.as_buffer()) if text.is_valid else b""
            pairs = spans.values
            if pairs is None or not len(pairs):
                rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), []))
                continue
            start, end = (np.asarray(pairs.field(k)) for k in ("start", "end"))
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            new = np.concatenate([[True], start[1:] > end[:-1]])
            a, b = start[new], end[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
            edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
            kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
            rows.append((len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())]))
        n, removed, spans, sha, removed_spans = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()),
             pa.array(removed_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed) of every document; doc_id must be an integer.

    A byte goes if a 100-byte string covers it that also starts earlier: in a smaller doc_id, or in the same text
    before. Windows of 100 bytes are grouped by a hash that equal windows share. Regions whose whole bytes equal
    an earlier region's are repeats; regions that share the hash but not all bytes are indexed together in a
    run-compressed Burrows-Wheeler transform with sampled run ends, whose matching statistics give the windows that
    start earlier. ``removed`` has the maximal runs as byte places.

    Null counts as empty; texts under 100 bytes lose nothing. Rows without doc_id lose nothing and take no part.
    Rows that repeat doc_id and text are one document, each with its result; a doc_id must not have two texts.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = texts.filter("doc_id is not null")
    own = W.partitionBy("m", "f").orderBy("doc_id", "first")
    found = spread(find_regions(numbered), "m").withColumn("nth", F.rank().over(own))
    near = W.partitionBy("m")
    found = found.withColumn("mixed", F.min("f").over(near) != F.max("f").over(near)).withColumn("crowd", F.sum((F.col("nth") == 1).cast("long")).over(near))
    found = found.filter("sure or nth > 1 or mixed").select("doc_id", "first", "more", "m", (F.col("sure") | (F.col("nth") > 1)).alias("repeat"), (F.col("crowd") > GROUP_ROWS).alias("crowded"))
    found = write_down(found, "regions")
    wanted = found.filter("not repeat").groupBy("doc_id").agg(F.collect_set(F.struct("first", "more", "m", "crowded")).alias("wanted"))
    wanted = write_down(wanted, "wanted")
    contents = perhaps_in(numbered, wanted, "doc_id").join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(
        _cut_regions, "m long, doc_id long, first long, crowded boolean, content binary"
    )
    contents = write_down(contents, "contents")
    marks = mark_repeats(contents.filter("not crowded"))
    if not contents.filter("crowded").isEmpty():
        marks = marks.unionByName(mark_crowded(contents.filter("crowded")))
    repeats = found.filter("repeat").select("doc_id", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("more") + MATCH).cast("long").alias("end"))
    spans = write_down(repeats.unionByName(marks).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("_slot")
    slots = F.broadcast(spans.select(slot).distinct())
    none = texts.withColumn("_slot", slot).join(slots, "_slot", "left_anti")
    untouched = none.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"), F.array().cast("array<struct<start:long,end:long>>").alias("removed"),
    )
    touched = perhaps_in(texts, spans, "doc_id").join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_keep, _RESULT)
    return untouched.unionByName(touched)
