"""Whole grids as rows: the steps of ``raster`` and ``regions`` on one array per image or mask.

A grid has a fixed longest side, so a row is bounded; images and masks spread over the cluster and no step moves cells. The
values are those of the cell tables, which are for grids with cells missing or repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shelf.operators.raster import LUMA
from shelf.operators.regions import joined_labels

MASK = "mask string, `rank` int, gw int, gh int, `on` binary"


def _rows(df: DataFrame, each: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """The rows that ``each`` makes of a row's values; image_id comes first on either side."""
    kind = df.schema["image_id"].dataType.simpleString()
    names = ["image_id", *[part.split()[0].strip("`") for part in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(row[0], *made) for row in batch.itertuples(index=False) for made in each(*row[1:])]
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, f"image_id {kind}, {schema}")


def _bits(on: np.ndarray) -> bytes:
    return np.packbits(on).tobytes()


def _mask(bits: bytes, gw: int, gh: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=gw * gh).reshape(gh, gw).astype(bool)


def _colors(gw: int, gh: int, *rgb: np.ndarray) -> list[np.ndarray]:
    return [np.asarray(c, np.float64).reshape(gh, gw) for c in rgb]


def _luma(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


# -- windows ---------------------------------------------------------------------------------


def line_sums(a: np.ndarray, k: int) -> np.ndarray:
    """Sums of ``k`` neighbours along the rows of ``a``; beyond an end the end value repeats."""
    n, r = a.shape[1], k // 2
    total = np.zeros(a.shape)
    for d in range(-r, k - r):
        low, high = max(0, -d), min(n, n - d)
        if low < high:
            total[:, low:high] += a[:, low + d : high + d]
    at = np.arange(n)
    return total + np.maximum(0, r - at) * a[:, :1] + np.maximum(0, at + (k - 1 - r) - (n - 1)) * a[:, -1:]


def blurred(a: np.ndarray, k: int) -> np.ndarray:
    return line_sums(line_sums(a, k).T, k).T / (k * k)


def grown(on: np.ndarray, k: int) -> np.ndarray:
    """Cells with a set one in the k x k cells around them."""
    for _ in range(2):
        wide = on.copy()
        for d in range(1, min(k // 2, on.shape[1] - 1) + 1):
            wide[:, d:] |= on[:, :-d]
            wide[:, :-d] |= on[:, d:]
        on = wide.T
    return on


def opened_and_closed(on: np.ndarray) -> np.ndarray:
    """As :func:`shelf.operators.raster.open_close`."""
    side = min(on.shape)
    k_open, k_close = max(3, int(side * 0.015)) | 1, max(5, int(side * 0.03)) | 1
    opened = grown(~grown(~on, k_open), k_open)
    return ~grown(~grown(opened, k_close), k_close)


def border(gw: int, gh: int) -> np.ndarray:
    frame = max(3, int(min(gw, gh) * 0.04))
    inner = np.ones((gh, gw), bool)
    inner[frame : gh - frame, frame : gw - frame] = False
    return inner


# -- regions ---------------------------------------------------------------------------------


def labels(on: np.ndarray) -> tuple[np.ndarray, int]:
    """The 4-connected regions of set cells, numbered by the first run of each in reading order, and how many runs there are."""
    starts = on.copy()
    starts[:, 1:] &= ~on[:, :-1]
    run = (np.cumsum(starts.ravel()) - 1).reshape(on.shape)
    n = int(starts.sum())
    both = on[1:] & on[:-1]
    return joined_labels(n, run[1:][both], run[:-1][both])[run] if n else run, n


def filled(on: np.ndarray) -> np.ndarray:
    """Every cell set that the border cannot reach over unset cells."""
    free = ~on
    label, n = labels(free)
    reached = np.zeros(n + 1, bool)
    for edge in (np.s_[0], np.s_[-1], np.s_[:, 0], np.s_[:, -1]):
        reached[label[edge][free[edge]]] = True
    return ~(free & reached[label])


def largest(on: np.ndarray) -> np.ndarray:
    """The largest region, the first in reading order among equals."""
    label, _ = labels(on)
    return on & (label == np.bincount(label[on]).argmax())


def corners(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the corners of the first and last cell of each row and column."""
    found = []
    for m in (on, on.T):
        line = np.flatnonzero(m.any(1))
        low, high = m[line].argmax(1), m.shape[1] - m[line, ::-1].argmax(1)
        found.append((np.tile(np.concatenate([low, high]), 2), np.concatenate([line, line, line + 1, line + 1])))
    (x, y), (y2, x2) = found
    return np.concatenate([x, x2]), np.concatenate([y, y2])


# -- steps over rows -------------------------------------------------------------------------


def blur(grids: DataFrame, k: int) -> DataFrame:
    """``grids`` (image_id, gw, gh, r, g, b) blurred, with the median colours of the frame."""

    def each(gw, gh, *rgb):
        smooth = [blurred(c, k) for c in _colors(gw, gh, *rgb)]
        frame = border(gw, gh)
        return [(gw, gh, *(c.ravel() for c in smooth), *(float(np.median(c[frame])) for c in smooth))]

    return _rows(grids.select("image_id", "gw", "gh", "r", "g", "b"), each, "gw int, gh int, r array<double>, g array<double>, b array<double>, bg_r double, bg_g double, bg_b double")


def _otsu(lum: np.ndarray) -> float:
    seen = lum[(lum >= 0) & (lum <= 255)]
    if not len(seen):
        return 127.0
    n = np.bincount(np.minimum(np.floor(seen * (256 / 255.0)), 255).astype(int), minlength=256).astype(float)
    bins = np.flatnonzero(n)
    n, center = n[bins], (bins + 0.5) * (255.0 / 256)
    w0, s0 = np.cumsum(n), np.cumsum(n * center)
    w1 = w0[-1] - w0
    gap = s0 / np.maximum(w0, 1) - (s0[-1] - s0) / np.maximum(w1, 1)
    between = np.where(w1 == 0, 0.0, w0 * w1 * gap * gap)
    best = between.argmax()
    return 0.5 * 255 / 256 if between[best] == 0 else float(center[best])


def candidate_masks(smooth: DataFrame, tolerance: float) -> DataFrame:
    """The masks of :func:`shelf.operators.raster.candidate_masks`, one row each."""

    def each(gw, gh, *rgb):
        r, g, b = _colors(gw, gh, *rgb)
        frame = border(gw, gh)
        light = _luma(r, g, b)
        light = light > _otsu(light.ravel())
        diff = np.maximum.reduce([np.abs(c - np.median(c[frame])) for c in (r, g, b)])
        hue = np.maximum.reduce([np.abs(c - np.median(c[frame])) for c in (r - g, g - b)])
        spread, hue_spread = np.median(diff[frame]), np.median(hue[frame])
        masks = {
            "bright": light if light[frame].mean() <= 0.5 else ~light,
            "contrast": diff > max(float(tolerance), 4.0 * spread),
            "contrast-low": diff > max(8.0, 0.4 * tolerance, 3.0 * spread),
            "chroma": hue > max(10.0, 4.0 * hue_spread),
        }
        return [(name, i, gw, gh, _bits(on)) for i, (name, on) in enumerate(masks.items())]

    return _rows(smooth.select("image_id", "gw", "gh", "r", "g", "b"), each, MASK)


def edge_lines(smooth: DataFrame) -> DataFrame:
    """The masks of :func:`shelf.operators.raster.edge_lines`, one row each."""

    def each(gw, gh, *rgb):
        grad = np.zeros((gh, gw))
        for c in _colors(gw, gh, *rgb):
            c = blurred(c, 3)
            grad[:, 1:] = np.maximum(grad[:, 1:], np.abs(c[:, 1:] - c[:, :-1]))
            grad[1:] = np.maximum(grad[1:], np.abs(c[1:] - c[:-1]))
        return [("edges", rank, gw, gh, _bits(grown(grad > limit, 5))) for rank, limit in ((4, 2.5), (5, 4.0))]

    return _rows(smooth.select("image_id", "gw", "gh", "r", "g", "b"), each, MASK)


def _per_mask(masks: DataFrame, step: Callable[[np.ndarray], np.ndarray | None]) -> DataFrame:
    def each(mask, rank, gw, gh, bits):
        on = step(_mask(bits, gw, gh))
        return [] if on is None else [(mask, rank, gw, gh, _bits(on))]

    return _rows(masks.select("image_id", "mask", "rank", "gw", "gh", "on"), each, MASK)


def fill_holes(masks: DataFrame) -> DataFrame:
    return _per_mask(masks, filled)


def clean_regions(masks: DataFrame) -> DataFrame:
    """The one region each mask stands for: specks removed, gaps closed, holes filled, largest kept."""

    def step(on: np.ndarray) -> np.ndarray | None:
        on = filled(opened_and_closed(on))
        return largest(on) if on.any() else None

    return _per_mask(masks, step)


def region_corners(regions: DataFrame) -> DataFrame:
    """(image_id, mask, rank, area, gw, gh, xs, ys) of regions, as :func:`shelf.operators.regions.smallest_rectangles` reads them."""

    def each(mask, rank, gw, gh, bits):
        on = _mask(bits, gw, gh)
        return [(mask, rank, int(on.sum()), gw, gh, *corners(on))]

    return _rows(regions.select("image_id", "mask", "rank", "gw", "gh", "on"), each, "mask string, `rank` int, area bigint, gw int, gh int, xs array<int>, ys array<int>")


def paper_masks(smooth: DataFrame, regions: DataFrame, gaps: tuple[float, ...]) -> DataFrame:
    """Masks of all cells near the paper's colour, the median of a region's brighter half; one region per image."""

    def each(gw, gh, r, g, b, bits):
        rgb, inside = _colors(gw, gh, r, g, b), _mask(bits, gw, gh)
        lum = _luma(*rgb)
        paper = inside & (lum >= np.median(lum[inside]))
        gap = np.maximum.reduce([np.abs(c - np.median(c[paper])) for c in rgb])
        return [("paper-colour", 6 + i, gw, gh, _bits(gap < limit)) for i, limit in enumerate(gaps)]

    rows = smooth.select("image_id", "gw", "gh", "r", "g", "b").join(regions.select("image_id", "on"), "image_id")
    return _rows(rows, each, MASK)
