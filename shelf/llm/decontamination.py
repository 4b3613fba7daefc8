"""Benchmark decontamination by the q-gram lemma: counts in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelf.llm import textbytes as tb

Q = 8
EDIT_RATE = 0.1
BLOCK_BYTES = 2 << 20
_PLAIN = tb.LOWER.copy()
_PLAIN[:128][~np.isin(np.arange(128), [*range(48, 58), *range(65, 91), *range(97, 123)])] = 0x20
_TABLE_BITS = 22
_OFFSET = 1 << 22
_FAR = 1 << 30


def plain(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with A-Z lower-cased and every run of signs and white space as one space, none at the ends; their
    bounds, and where each byte stood."""
    low = _PLAIN[data]
    keep = np.ones(len(low), bool)
    space = low == 0x20
    keep[:-1] = ~(space[:-1] & space[1:])
    if len(low):
        ends = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        keep[ends] &= ~space[ends]
        inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(low))]
        crossing = inner - 1
        keep[crossing] = ~space[crossing]
    where = np.flatnonzero(keep)
    new = np.searchsorted(where, bounds)
    first = new[:-1][new[:-1] < new[1:]]
    lead = first[low[where[first]] == 0x20]
    if len(lead):
        where = np.delete(where, lead)
        new = np.searchsorted(where, bounds)
    return low[where], new, where


class ItemIndex:
    """A block of benchmark items: their q-grams, lengths, edit budgets and the shared q-grams each budget asks for."""

    def __init__(self, ids: list[int], texts: list[str], q: int, edit_rate: float):
        column = pa.array(texts, pa.large_string()).cast(pa.large_binary())
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
        self.q, self.ids = q, np.array(ids, np.int64)
        self.data, self.bounds, _ = plain(data, offsets)
        self.length = np.diff(self.bounds)
        self.budget = np.clip(np.minimum((self.length * edit_rate).astype(np.int64), (self.length - q) // q), 0, None)
        self.need = np.maximum(1, self.length - q + 1 - self.budget * q)
        h, at = qgrams(self.data, self.bounds, q)
        order = np.argsort(h, kind="stable")
        self.hash, at = h[order], at[order]
        self.item = np.searchsorted(self.bounds, at, "right") - 1
        self.place = at - self.bounds[self.item]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.hash >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.shorts: dict[bytes, list[int]] = {}
        for i in range(len(ids)):
            if 0 < self.length[i] < q:
                self.shorts.setdefault(self.text(i).tobytes(), []).append(i)

    def text(self, i: int) -> np.ndarray:
        return self.data[self.bounds[i] : self.bounds[i + 1]]


def qgrams(data: np.ndarray, bounds: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all q-grams that lie within one text, and where they start."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = (h * np.uint64(257)) + data[i : i + n]
    inside = np.ones(len(data), bool)
    for b in bounds[1:]:
        inside[max(0, b - q + 1) : b] = False
    at = np.flatnonzero(inside[:n])
    return tb.mixed(h[at]), at


def banded_edits(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """The best alignment of the whole item with a part of ``text`` on diagonals ``low`` to ``high`` (text place
    minus item place): edits, start and end in the text. None beyond ``budget`` edits."""
    n, width = len(text), high - low + 1
    padded = np.full(len(item) + width, 256, np.int16)  # no byte matches outside the text
    a, b = max(0, low), min(n, low + len(item) + width - 1)
    padded[a - low : max(a, b) - low] = text[a : max(a, b)]
    differs = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(item)] != item[:, None].astype(np.int16)
    steps = np.arange(width)
    start = steps + low
    cost = np.where((start < 0) | (start > n), _FAR, 0)
    inner = low >= 0 and high + len(item) <= n
    drop, lost = np.full(width, _FAR), np.zeros(width, np.int64)
    for i in range(len(item)):
        swap = cost + differs[i]
        drop[:-1] = cost[1:] + 1  # the item's byte is missing in the text
        lost[:-1] = start[1:]
        fewer = drop < swap
        slack = np.where(fewer, drop, swap) - steps  # further bytes of the text cost one each
        reach = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == reach, steps, 0))
        cost, start = reach + steps, np.where(fewer, lost, start)[source]
        if not inner:
            end = i + 1 + low + steps
            cost[(end < 0) | (end > n)] = _FAR
        if cost.min() > budget:
            return None
    k = int(np.argmin(cost))
    return int(cost[k]), int(start[k]), len(item) + low + k


def _enough(diagonal: np.ndarray, place: np.ndarray, budget: int, need: int) -> bool:
    """Whether some budget + 1 neighbouring diagonals share ``need`` q-grams of different places of the item."""
    if len(np.unique(place)) < need:
        return False
    order = np.argsort(diagonal, kind="stable")
    d, p = diagonal[order], place[order]
    to = np.searchsorted(d, d + budget, "right")
    return any(len(np.unique(p[i : to[i]])) >= need for i in np.flatnonzero(to - np.arange(len(d)) >= need).tolist())


def leaks_in_chunk(chunk: tb.Chunk, index: ItemIndex) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each text of a chunk with leaks: (item number, start, end, edits), places in the text's own bytes."""
    data, bounds, where = plain(chunk.data, chunk.bounds)
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for t in np.flatnonzero(np.diff(bounds) < index.q) if index.shorts else ():
        a, b = int(bounds[t]), int(bounds[t + 1])
        for i in index.shorts.get(data[a:b].tobytes(), ()):
            base = int(chunk.bounds[t])
            found.setdefault(int(t), []).append((i, int(where[a]) - base, int(where[b - 1]) + 1 - base, 0))
    h, at = qgrams(data, bounds, index.q)
    maybe = index.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
    h, at = h[maybe], at[maybe]
    left, right = np.searchsorted(index.hash, h, "left"), np.searchsorted(index.hash, h, "right")
    n = right - left
    if not n.sum():
        return found
    rank = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
    at = np.repeat(at, n)
    item = index.item[rank]
    text = np.searchsorted(bounds, at, "right") - 1
    diagonal = at - bounds[text] - index.place[rank]
    step = index.budget[item] + 1
    band = diagonal // step + _OFFSET
    key = (text.astype(np.int64) * len(index.ids) + item) * (1 << 32) + band
    order = np.argsort(key, kind="stable")
    key, diagonal, place = key[order], diagonal[order], index.place[rank][order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    cells, count = key[head], np.diff(np.append(head, len(key)))
    both = count.copy()
    joined = np.flatnonzero(np.diff(cells) == 1)
    both[joined] += count[joined + 1]
    pair = cells >> 32
    good = np.flatnonzero(both >= index.need[pair % len(index.ids)])
    tried: dict[tuple[int, int], int] = {}
    for c in good.tolist():
        t, i = divmod(int(pair[c]), len(index.ids))
        k, d = int(index.budget[i]), (int(cells[c] & 0xFFFFFFFF) - _OFFSET) * int(index.budget[i] + 1)
        own, wanted = data[bounds[t] : bounds[t + 1]], index.text(i)
        if tried.get((t, i), -(1 << 40)) > d:  # inside the last match
            continue
        near = slice(head[c], head[c] + both[c])
        if not _enough(diagonal[near], place[near], k, int(index.need[i])):
            continue
        a = max(0, d - k)
        region = own[a : d + 2 * (k + 1) + len(wanted) + k]
        exact = region.tobytes().find(wanted.tobytes())
        hit = (0, a + exact, a + exact + len(wanted)) if exact >= 0 else banded_edits(wanted, own, d - k, d + 2 * (k + 1) + k, k)
        if hit:
            edits, s, e = hit
            s, e = max(0, s), max(s + 1, e)
            tried[(t, i)] = s + len(wanted) // 2
            at0, at1, base = int(where[bounds[t] + s]), int(where[bounds[t] + min(e, len(own)) - 1]) + 1, int(chunk.bounds[t])
            found.setdefault(t, []).append((i, at0 - base, at1 - base, edits))
    return found


def item_blocks(benchmark: DataFrame, q: int, edit_rate: float, limit: int = BLOCK_BYTES) -> Iterator[ItemIndex]:
    """The benchmark in blocks of at most ``limit`` characters (or one item). Null and empty items are left out."""
    ids, texts, size = [], [], 0
    for item_id, text in benchmark.select("item_id", "text").filter("item_id is not null and text <> ''").orderBy("item_id").toLocalIterator():
        if ids and size + len(text) > limit:
            yield ItemIndex(ids, texts, q, edit_rate)
            ids, texts, size = [], [], 0
        ids.append(item_id)
        texts.append(text)
        size += len(text)
    if ids:
        yield ItemIndex(ids, texts, q, edit_rate)


_SPANS = "array<struct<item_id:long,start:long,end:long,edits:long>>"
_SPAN_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, clean_only: bool = False) -> DataFrame:
    """``docs`` with ``spans``: item_id, start, end (bytes of the text) and edits of every benchmark item found; or
    with ``clean_only`` the documents without any, unchanged.

    Texts and items are compared with A-Z lower-cased and runs of signs and white space as one space. An item of
    m bytes is found where a part of the text is at most k = min(edit_rate * m, m / q - 1) edits away. Such a part
    shares at least m - q + 1 - k * q q-grams with it on k + 1 neighbouring diagonals, so only bands with that many
    are aligned. An item shorter than q is found in texts equal to it. Null and empty texts have no spans. A
    benchmark beyond BLOCK_BYTES is taken in blocks, one pass over ``docs`` each. Texts of any length are searched whole;
    repeated rows each have their spans; spans of equal start go by item_id. Other columns pass through. If ``docs`` has a
    column ``spans`` it stays, and the result is the column ``spans_found`` (with one more ``_`` for each such column there is).
    """
    sc = docs.sparkSession.sparkContext
    none, name = F.array().cast(_SPANS), "spans"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "spans_found" if name == "spans" else f"{name}_"
    rows = docs if clean_only else docs.withColumn(name, none)
    for index in item_blocks(benchmark, q, edit_rate):
        rows = _against(rows, sc.broadcast(index), clean_only, name)
    return rows


def _against(rows: DataFrame, shared, clean_only: bool, name: str) -> DataFrame:
    names = rows.columns  # columns go to tasks by their places, as their names may hold dots
    plain = rows.toDF(*[f"c{k}" for k in range(len(names))])
    text_at = f"c{names.index('text')}"
    spans_at = None if clean_only else f"c{names.index(name)}"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found: dict[int, list] = {}
            for chunk in tb.chunks(batch.column(text_at)):
                for t, spans in leaks_in_chunk(chunk, index).items():
                    found[chunk.first + t] = [{"item_id": int(index.ids[i]), "start": a, "end": b, "edits": e} for i, a, b, e in sorted(spans, key=lambda x: (x[1], x[0]))]
            if clean_only:
                clean = np.ones(batch.num_rows, bool)
                clean[list(found)] = False
                yield batch.filter(pa.array(clean))
            else:
                old = batch.column(spans_at).to_pylist()
                spans = pa.array([(x or []) + found.get(k, []) for k, x in enumerate(old)], _SPAN_TYPE)
                yield pa.RecordBatch.from_arrays([spans if n == spans_at else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return plain.mapInArrow(search, plain.schema).toDF(*names)
