"""Decoded photos: grids of cells and perceptual hashes."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelf.functions import paths as P
from shelf.session import shared_dir, spread, write_down
from shelf.sources.listing import read_below, read_listing
from shelf.sources.orientation import file_orientation, upright
from shelf.sources.walk import file_bytes, reachable, write_bytes

_PIXELS = "full_path string, w int, h int, gw int, gh int, r array<float>, g array<float>, b array<float>"


def _named_apart(path: str) -> str:
    """A file name that Spark's file sources read, of the same type."""
    return f"f{hashlib.sha256(path.encode()).hexdigest()}{os.path.splitext(path)[1]}"


def _decoded(files: DataFrame) -> DataFrame:
    return files.select(
        P.path_from_uri("image.origin").alias("full_path"), "image.width", "image.height", "image.nChannels", "image.data",
        F.when(F.col("image.height") > 0, "ok").otherwise("error").alias("status"),
    )


def _underscored(spark: SparkSession, root: str) -> DataFrame | None:
    """Images whose own name starts with ``_``, which Spark's image source leaves out: tasks copy them under other names
    into the shared folder, where it reads them."""
    name = P.basename("full_path")
    files = read_listing(spark, root).filter(name.startswith("_") & F.lower(P.extension(name)).isin(*P.IMAGE_TYPES)).select("full_path")
    folder = f"{shared_dir(spark)}/images-{uuid.uuid4().hex}"

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            status = []
            for path in batch["full_path"]:
                if not (reachable(path) and reachable(folder)):
                    status.append("error")
                    continue
                try:
                    write_bytes(f"{folder}/{_named_apart(path)}", file_bytes(path))
                    status.append("ok")
                except OSError:
                    status.append("error")
            yield pd.DataFrame({"full_path": batch["full_path"], "copied": status, "name": batch["full_path"].map(_named_apart)})

    copies = write_down(spread(files).mapInPandas(copy, "full_path string, copied string, name string"), "copies")
    if copies.isEmpty():
        return None
    lost = copies.filter("copied = 'error'").select(
        "full_path", *[F.lit(-1).alias(c) for c in ("width", "height", "nChannels")], F.lit(b"").alias("data"), F.lit("error").alias("status")
    )
    if copies.filter("copied = 'ok'").isEmpty():
        return lost
    read = _decoded(spark.read.format("image").load(folder)).withColumn("name", P.basename("full_path")).drop("full_path")
    return read.join(copies.select("full_path", "name"), "name").select(lost.columns).unionByName(lost)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Images below ``root``: full_path, width, height, nChannels, data (blue, green, red), status, orientation.

    JPEG, PNG, BMP, GIF and TIFF are decoded in the JVM; WebP is not. A file named like an image that cannot be read has
    status ``error`` and no data; grids and hashes leave such rows out. ``orientation`` is what the file's header notes, null
    where it cannot be looked at; width, height and data are as stored, grids and hashes are of the upright photo.
    """
    images = _decoded(read_below(spark, root, "image", F.col("image.origin")))
    more = _underscored(spark, root)
    if more is not None:
        images = images.unionByName(more)
    named = images.filter((F.col("status") == "ok") | F.lower(P.extension(P.basename("full_path"))).isin(*P.IMAGE_TYPES))
    return named.withColumn("orientation", file_orientation("full_path"))


def _with_turn(images: DataFrame) -> DataFrame:
    """The columns that pixels are made of; images of tables without ``orientation`` are upright."""
    turn = F.coalesce("orientation", F.lit(1)) if "orientation" in images.columns else F.lit(1)
    return images.filter("height > 0").select("full_path", "width", "height", "nChannels", "data", turn.alias("turn"))


def _colors(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """height x width x (red, green, blue) from the reader's bytes."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float32)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def _averaged(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean of the whole pixels under each target cell, one axis at a time."""
    for axis, n in ((0, rows), (1, cols)):
        size = a.shape[axis]
        if n != size:
            centers = (np.arange(n) + 0.5) * size / n
            half = max(size / n, 1.0) / 2
            low = np.maximum(np.floor(centers - half + 0.5).astype(int), 0)
            high = np.minimum(np.floor(centers + half + 0.5).astype(int), size)
            high = np.maximum(high, low + 1)
            total = np.cumsum(np.insert(a.astype(np.float64), 0, 0, axis=axis), axis=axis)
            count = (high - low).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
            a = (np.take(total, high, axis=axis) - np.take(total, low, axis=axis)) / count
    return a


def grid_size(width: int, height: int, long_side: int, smallest: int = 16, grow: bool = False) -> tuple[int, int]:
    """(columns, rows) of the grid of a photo; photos are not enlarged unless ``grow``."""
    s = long_side / max(width, height)
    if s >= 1 and not grow:
        return width, height
    return max(smallest, round(width * s)), max(smallest, round(height * s))


def to_grids(images: DataFrame, long_side: int = 480, smallest: int = 16, cell: int = 1, grow: bool = False) -> DataFrame:
    """One row per image with w, h and flat arrays r, g, b of a grid with at most ``long_side`` cells a side, all of the
    upright photo; each cell is made of ``cell`` x ``cell`` averaged values. Bytes are only touched here."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, w, h, channels, data, turn in batch.itertuples(index=False):
                photo = upright(_colors(h, w, channels, data), turn)
                h, w = photo.shape[:2]
                gw, gh = grid_size(w, h, long_side, smallest, grow)
                a = _averaged(photo, gh * cell, gw * cell).astype(np.float32)
                out.append((path, w, h, gw * cell, gh * cell, *(a[:, :, c].ravel() for c in range(3))))
            yield pd.DataFrame(out, columns=["full_path", "w", "h", "gw", "gh", "r", "g", "b"])

    return _with_turn(images).mapInPandas(convert, _PIXELS)


_TWO = f"{_PIXELS}, fine_gw int, fine_gh int, fine_r array<float>, fine_g array<float>, fine_b array<float>, reason string"


def two_grids(images: DataFrame, long_side: int = 480, fine_side: int = 1600) -> DataFrame:
    """One row per image, also of those that cannot be decoded: the grid of ``to_grids`` (gw, gh, r, g, b), a finer one
    (fine_gw, …), and ``reason``, null where there are grids. Bytes are decoded once for both; write the table down
    and read the columns that are needed."""
    width, height, channels, data, turn = (F.col(c) for c in ("width", "height", "nChannels", "data", "orientation")) if "orientation" in images.columns else (*(F.col(c) for c in ("width", "height", "nChannels", "data")), F.lit(1))

    def grid(photo: np.ndarray, side: int) -> tuple:
        gw, gh = grid_size(photo.shape[1], photo.shape[0], side)
        a = _averaged(photo, gh, gw).astype(np.float32)
        return gw, gh, *(a[:, :, c].ravel() for c in range(3))

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["full_path", "w", "h", "gw", "gh", "r", "g", "b", "fine_gw", "fine_gh", "fine_r", "fine_g", "fine_b", "reason"]
        for batch in batches:
            out = []
            for path, w, h, n, data, turn in batch.itertuples(index=False):
                try:
                    if not h > 0 or data is None:
                        raise ValueError("the file cannot be read as an image")
                    photo = upright(_colors(int(h), int(w), int(n), data), turn)
                    out.append((path, photo.shape[1], photo.shape[0], *grid(photo, long_side), *grid(photo, fine_side), None))
                except Exception as e:  # one photo's fault is that photo's row
                    out.append((path, *[None] * 12, str(e)[:200]))
            yield pd.DataFrame(out, columns=names).astype({c: "Int32" for c in ("w", "h", "gw", "gh", "fine_gw", "fine_gh")})

    rows = images.select("full_path", width.alias("w"), height.alias("h"), channels.alias("n"), data.alias("data"), F.coalesce(turn, F.lit(1)).alias("turn"))
    return rows.mapInPandas(convert, _TWO)


def to_cells(grids: DataFrame, by: str = "full_path") -> DataFrame:
    """Long table (``by``, y, x, r, g, b) of grids."""
    cells = grids.select(by, "gw", F.posexplode(F.arrays_zip("r", "g", "b")).alias("at", "c"))
    return cells.select(
        by, F.floor(F.col("at") / F.col("gw")).cast("int").alias("y"), (F.col("at") % F.col("gw")).alias("x"),
        *[F.col(f"c.{c}").cast("double").alias(c) for c in "rgb"],
    )


def _bits(flags: np.ndarray) -> int:
    return int(np.packbits(flags.ravel()).view(">u8")[0].astype(np.int64))


def perceptual_hashes(images: DataFrame) -> DataFrame:
    """(full_path, phash, dhash): 64-bit hashes of each image.

    phash: which of the 8 x 8 lowest cosine frequencies of a 32 x 32 grey image exceed their median;
    dhash: where brightness grows from one of 9 x 8 cells to the next. Cells are plain averages, so a
    few bits differ from libraries that resample otherwise; compare by distance.
    """
    n = np.arange(32)
    cosines = np.cos(np.pi * (2 * n[None, :] + 1) * np.arange(8)[:, None] / 64)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, w, h, channels, data, turn in batch.itertuples(index=False):
                grey = upright(_colors(h, w, channels, data), turn) @ np.array([0.299, 0.587, 0.114])
                low = cosines @ _averaged(grey, 32, 32) @ cosines.T
                small = np.round(_averaged(grey, 8, 9), 6)  # equal cells stay equal, whatever the sums' last digits
                out.append((path, _bits(low > np.median(low)), _bits(small[:, 1:] > small[:, :-1])))
            yield pd.DataFrame(out, columns=["full_path", "phash", "dhash"])

    return _with_turn(images).mapInPandas(convert, "full_path string, phash bigint, dhash bigint")
