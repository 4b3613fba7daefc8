"""Product codes of vectors: Lloyd's rounds over two trees, one over the vectors' parts and one over a codebook's entries.

Vectors are cut into blocks of bounded size. Each block keeps, for every part position, a tree over its parts: boxes that
halve at the widest side, with the sum and number of the parts below each node. The trees are built once and written down;
a round walks them beside a tree over the 16 entries of that position. All arithmetic is on integers, so no result depends
on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelf.llm.skew import join_groups
from shelf.session import write_down

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_BYTES = 1 << 20
LEAF = 32


class Trees:
    """A complete binary tree of boxes over points [n, d] for each of ``PARTS`` positions, level after level.

    ``order`` lists the points of a position so that every node holds a range of it. Node k of level l covers the range
    bounds[l][k] to bounds[l][k + 1]; low, high, total are by node, levels one after the other, the root first."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        n = points.shape[1]
        self.points, self.depth = points, max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        self.order = np.tile(np.arange(n), (len(points), 1))
        for level in range(self.depth + 1):
            bounds = self.bounds(level)
            if level == self.depth:
                break
            for part, order in zip(self.points, self.order):
                rows = part[order]
                low, high = np.minimum.reduceat(rows, bounds[:-1], 0), np.maximum.reduceat(rows, bounds[:-1], 0)
                side = (high - low).argmax(1)
                node = np.repeat(np.arange(len(side)), np.diff(bounds))
                order[:] = order[np.lexsort((rows[np.arange(n), side[node]], node))]
        self.low, self.high, self.total = [], [], []
        for level in range(self.depth + 1):
            starts = self.bounds(level)[:-1]
            rows = np.take_along_axis(points, self.order[:, :, None], 1)
            self.low.append(np.minimum.reduceat(rows, starts, 1))
            self.high.append(np.maximum.reduceat(rows, starts, 1))
            self.total.append(np.add.reduceat(rows, starts, 1))

    def bounds(self, level: int) -> np.ndarray:
        """Equal halves: a level has as many nodes of one size, give or take one point, as it can have."""
        n = self.points.shape[1]
        return np.arange((1 << level) + 1) * n >> level

    def pack(self) -> bytes:
        return b"".join(x.astype(np.int64).tobytes() for x in [self.order, *self.low, *self.high, *self.total])

    @classmethod
    def unpack(cls, points: np.ndarray, raw: bytes, leaf: int = LEAF) -> Trees:
        tree = cls.__new__(cls)
        p, n, d = points.shape
        tree.points, tree.depth = points, max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
        flat = np.frombuffer(raw, np.int64)
        tree.order = flat[: p * n].reshape(p, n)
        at = p * n
        for name in ("low", "high", "total"):
            levels = []
            for level in range(tree.depth + 1):
                size = p * d << level
                levels.append(flat[at : at + size].reshape(p, 1 << level, d))
                at += size
            setattr(tree, name, levels)
        return tree


def entry_tree(entries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(low, high, members) by level of a binary tree over a codebook [k, d]: members is a table node x entry."""
    groups = [np.arange(len(entries))]
    levels = []
    while True:
        there = np.zeros((len(groups), len(entries)), bool)
        for k, g in enumerate(groups):
            there[k, g] = True
        levels.append((np.stack([entries[g].min(0) for g in groups]), np.stack([entries[g].max(0) for g in groups]), there))
        if all(len(g) == 1 for g in groups):
            return levels
        halves = []
        for g in groups:
            g = g[np.argsort(entries[g][:, np.ptp(entries[g], 0).argmax()], kind="stable")]
            halves += [h for h in (g[: (len(g) + 1) // 2], g[(len(g) + 1) // 2 :]) if len(h)]
        groups = halves


def assign(tree: Trees, part: int, entries: np.ndarray, nearest: np.ndarray | None, sums: np.ndarray, counts: np.ndarray) -> None:
    """Walk one position's tree beside the entries' tree. ``sums`` and ``counts`` of the entries are added to; ``nearest``,
    where it is asked for, gets every point's entry, the lowest of those that are equally near.

    A pair of nodes goes when the least distance of their boxes exceeds the greatest distance of the point node to some
    other entry node. A point node with one entry left is assigned whole, by its cached sum; in leaves with several, points
    are compared by exact integer distances with the entries left."""
    points, order = tree.points[part], tree.order[part]
    levels = entry_tree(entries)
    at, left = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    for level in range(tree.depth + 1):
        bounds = tree.bounds(level)
        low, high = tree.low[level][part][at], tree.high[level][part][at]
        for e_low, e_high, members in levels:
            gap = np.maximum(0, np.maximum(e_low[None] - high[:, None], low[:, None] - e_high[None]))
            reach = np.maximum(high[:, None] - e_low[None], e_high[None] - low[:, None])
            open_node = (left[:, None] & members[None]).any(2)
            least = (gap * gap).sum(2)
            most = np.where(open_node, (reach * reach).sum(2), np.iinfo(np.int64).max)
            gone = open_node & (least > most.min(1)[:, None])
            left &= ~(gone[:, :, None] & members[None]).any(1)
        whole = left.sum(1) == 1
        entry = left.argmax(1)
        for k, node in zip(entry[whole], at[whole]):
            sums[k] += tree.total[level][part][node]
            counts[k] += bounds[node + 1] - bounds[node]
            if nearest is not None:
                nearest[order[bounds[node] : bounds[node + 1]]] = k
        at, left = at[~whole], left[~whole]
        if not len(at):
            return
        if level < tree.depth:
            at, left = np.stack([2 * at, 2 * at + 1], 1).ravel(), np.repeat(left, 2, 0)
    sizes = bounds[at + 1] - bounds[at]
    rows = np.repeat(bounds[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    rows, mine = order[rows], np.repeat(left, sizes, 0)
    x = points[rows]
    far = np.where(mine, (entries * entries).sum(1)[None] - 2 * (x @ entries.T), np.iinfo(np.int64).max)
    best = far.argmin(1)
    np.add.at(sums, best, x)
    np.add.at(counts, best, 1)
    if nearest is not None:
        nearest[rows] = best


def _blocks(width: int) -> object:
    """Arrow task: integer components of whole batches, in blocks with their trees."""
    limit = int(2 ** ((62 - np.log2(max(1, width))) / 2)) // 2
    rows = max(LEAF, BLOCK_BYTES // (8 * max(1, width)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), rows):
                piece = batch.slice(first, rows)
                lists = piece.column("v")
                lengths = np.asarray(lists.value_lengths())
                flat = np.clip(np.floor(np.asarray(lists.flatten(), np.float64) * SCALE), -limit, limit).astype(np.int64)
                x = np.zeros((len(piece), width), np.int64)
                x[np.arange(width)[None] < lengths[:, None]] = flat
                points = x.reshape(len(x), PARTS, width // PARTS).transpose(1, 0, 2)
                tree = Trees(np.ascontiguousarray(points))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([piece.column("label").to_pylist()], pa.list_(pa.string())),
                     pa.array([tree.points.astype(np.int32).tobytes()], pa.binary()), pa.array([tree.pack()], pa.binary())],
                    ["vec_ids", "labels", "points", "tree"],
                )

    return cut


def _unpacked(row: dict, width: int) -> tuple[int, Trees]:
    n = len(row["vec_ids"])
    points = np.frombuffer(row["points"], np.int32).astype(np.int64).reshape(PARTS, n, width // PARTS)
    return n, Trees.unpack(points, row["tree"])


def _summed(books: np.ndarray, width: int) -> object:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in (r for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
                n, tree = _unpacked(row, width)
                for part in range(PARTS):
                    assign(tree, part, books[part], None, sums[part], counts[part])
        p, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(counts[p, k], pa.int64()), pa.array(sums[p, k].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"]
        )

    return walk


def _coded(books: np.ndarray, width: int) -> object:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
                n, tree = _unpacked(row, width)
                codes, error = np.zeros((n, PARTS), np.int64), np.zeros(n, np.int64)
                for part in range(PARTS):
                    assign(tree, part, books[part], codes[:, part], np.zeros_like(books[part]), np.zeros(len(books[part]), np.int64))
                    off = tree.points[part] - books[part][codes[:, part]]
                    error += (off * off).sum(1)
                code = ["".join(f"{c:02x}" for c in r) for r in codes.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"]
                )

    return walk


def first_codebooks(kept: DataFrame, width: int, entries: int = ENTRIES) -> np.ndarray:
    """[part, entry, component] of the ``entries`` smallest vec_ids; equal ids by their components, null ids last."""
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE))
    rows = kept.select("vec_id", scaled.alias("x")).orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    limit = int(2 ** ((62 - np.log2(max(1, width))) / 2)) // 2
    x = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        x[k, : len(r["x"])] = np.clip(r["x"], -limit, limit)
    return np.ascontiguousarray(x.reshape(len(rows), PARTS, width // PARTS).transpose(1, 0, 2))


def learn_codebooks(blocks: DataFrame, books: np.ndarray, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """``rounds`` rounds of Lloyd's method over written blocks. Each round sends one row per part and entry to the driver."""
    for _ in range(rounds):
        partial = blocks.select("vec_ids", "points", "tree").mapInArrow(_summed(books, width), "part int, entry int, n long, total array<long>")
        cells = partial.select("part", "entry", "n", F.posexplode("total").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        books = books.copy()
        for r in cells.collect():
            books[r["part"], r["entry"], r["place"]] = r["x"] // r["n"]
    return books


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def vector_blocks(kept: DataFrame, width: int) -> DataFrame:
    """Written blocks of (vec_id, label, v) with their trees."""
    return write_down(kept.mapInArrow(_blocks(width), "vec_ids array<long>, labels array<string>, points binary, tree binary"), "vectors")


def compress_vectors(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every row whose vector has finite components only.

    Components become floor(4096 x) and are cut into 8 parts; each part is coded by the nearest of 16 entries after
    ``rounds`` rounds. Vectors shorter than the longest, and lengths that 8 does not divide, are filled up with zeros.
    Components whose distances could pass 64 bits (beyond 32,768 for 64 components) count as that bound. Rows whose vector
    is null or holds null or non-finite components have no result. Rows may repeat a vec_id, each has its code; a null
    vec_id is coded like any other but starts no entry while there are others. Fewer than 16 rows start as many entries.
    ``label_error`` sums the errors over equal labels, nulls together; it is taken as text, so a label may be of any
    simple type. An empty table gives no rows. Other columns are not looked at.
    """
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.filter(F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v")
    )
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(PARTS, -(-width // PARTS) * PARTS)
    blocks = vector_blocks(kept, width)
    books = learn_codebooks(blocks, first_codebooks(kept, width), width, rounds)
    coded = blocks.mapInArrow(_coded(books, width), "vec_id long, label string, code string, error long") if books.size else blocks.sparkSession.createDataFrame([], "vec_id long, label string, code string, error long")
    key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), "label"))
    coded = write_down(coded.withColumn("_group", key), "codes")
    groups = coded.groupBy("_group").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    sha = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return join_groups(coded, groups, "_group", "_n", coded.count()).select("vec_id", "label", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
