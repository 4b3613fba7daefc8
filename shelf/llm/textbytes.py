"""Texts as UTF-8 byte arrays inside Arrow tasks: chunks of whole texts, words, rolling hashes.

Hashes are 64-bit polynomial prefix sums over random byte values, so the hash of any byte range costs one
subtraction and one product, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Chunk:
    """Consecutive whole texts of a batch: rows ``first`` to ``last``, bytes, and the texts' bounds in them."""

    def __init__(self, first: int, last: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.last, self.data, self.bounds = first, last, data, bounds

    def __len__(self) -> int:
        return self.last - self.first


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column of texts into chunks of at most ``limit`` bytes; a longer text is a chunk of its own.
    Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Chunk(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, x in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 2 * CHUNK_BYTES), x, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums h with h[0] = 0; see :func:`range_hash`."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * powers(len(data) + 1)[0][: len(data)], out=h[1:])
    return h


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end): equal for equal bytes, wherever they stand."""
    return mixed((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of one nonzero ``kind`` (a table of 256), never across texts: start, end and text number."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    k = kind[data].astype(np.uint8)
    change = np.ones(len(data) + 1, bool)
    np.not_equal(k[1:], k[:-1], out=change[1:-1])
    change[bounds] = True
    at = np.flatnonzero(change)
    word = k[at[:-1]] > 0
    start, end = at[:-1][word], at[1:][word]
    return start, end, np.searchsorted(bounds, start, "right") - 1
