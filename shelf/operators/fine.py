"""Evidence along the sides of rectangles on a finer grid than they were found on.

A photo's fine grid is large, so it travels once: one row per photo meets the few rectangles of its masks, and whole arrays
are sampled in the task. The same steps as columns, for grids that are small, are in ``edges``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shelf.operators.raster import LUMA
from shelf.session import spread

SIDES = ("x0", "x1", "y0", "y1")
#: A photo's fine grid has at most so many cells a side.
FINE_SIDE = 1600


class Photo:
    """Fine grid of one photo: lum [h, w], rgb [h, w, 3]."""

    def __init__(self, width: int, height: int, r: np.ndarray, g: np.ndarray, b: np.ndarray):
        self.w, self.h = width, height
        self.rgb = np.stack([np.asarray(c, np.float64) for c in (r, g, b)], 1).reshape(height, width, 3)
        self.lum = self.rgb[..., 0] * LUMA[0] + self.rgb[..., 1] * LUMA[1] + self.rgb[..., 2] * LUMA[2]
        short = min(width, height)
        self.reach = max(6, round(0.025 * short))
        self.depth = max(3.0, 0.012 * short)

    def cells(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the nearest cells; points outside take the border's."""
        return np.clip(np.rint(py), 0, self.h - 1).astype(np.intp), np.clip(np.rint(px), 0, self.w - 1).astype(np.intp)

    def beyond(self, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        return (px < 0) | (px > self.w - 1) | (py < 0) | (py > self.h - 1)


class Frame:
    """A turned rectangle: its sides are numbers in a frame turned by ``ang``."""

    def __init__(self, ang: float, sides: dict[str, float]):
        self.cos, self.sin, self.sides = np.cos(ang), np.sin(ang), dict(sides)

    def span(self, side: str) -> tuple[float, float]:
        """The ends of a side, along it."""
        low, high = ("y0", "y1") if side[0] == "x" else ("x0", "x1")
        return self.sides[low], self.sides[high]

    def length(self, side: str) -> float:
        return self.sides[side[0] + "1"] - self.sides[side[0] + "0"]

    def image(self, side: str, across: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fx, fy = (across, along) if side[0] == "x" else (along, across)
        return fx * self.cos - fy * self.sin, fx * self.sin + fy * self.cos


def _shares(low: float, high: float, n: int) -> np.ndarray:
    """As in ``edges``: points that fall between two cells go to the same one."""
    return np.array([low + (high - low) * i / (n - 1) for i in range(n)])


def _inward(side: str) -> float:
    return 1.0 if side[1] == "0" else -1.0


def snapped(photo: Photo, frame: Frame) -> Frame:
    """Each side on the steepest brightness edge within reach, where half of 25 lines see a clear one and agree on it."""
    out = Frame(0.0, frame.sides)
    out.cos, out.sin = frame.cos, frame.sin
    offsets = np.arange(-photo.reach, photo.reach + 1)
    for side in SIDES:
        low, high = out.span(side)
        along = low + _shares(0.15, 0.85, 25)[:, None] * (high - low)
        lines = photo.lum[photo.cells(*out.image(side, out.sides[side] + offsets[None], along))]
        near = np.pad(lines, ((0, 0), (2, 2)), mode="edge")
        smooth = sum(near[:, k : k + lines.shape[1]] for k in range(5)) / 5
        steps = np.abs(smooth[:, 2:] - smooth[:, :-2])
        clear = steps.max(1) > 6.0
        if 2 * clear.sum() < len(clear):
            continue
        shift = offsets[1:-1][steps.argmax(1)[clear]]
        middle = float(np.median(shift))
        if np.percentile(np.abs(shift - middle), 75) <= max(2.0, 0.3 * photo.reach):
            out.sides[side] += middle
    return out if out.length("x0") >= 4 and out.length("y0") >= 4 else frame


def near_border(photo: Photo, frame: Frame, side: str) -> bool:
    low, high = frame.span(side)
    px, py = frame.image(side, frame.sides[side], 0.5 * (low + high))
    m = max(2.0, 0.8 * photo.depth)
    return bool(px < m or py < m or px > photo.w - m or py > photo.h - m)


def contrasts(photo: Photo, frame: Frame) -> tuple[list[float], int, float]:
    """Colour gaps of the sides inside the photo, how many sides are not, and how far the sides' inner strips share a colour.
    Of a strip the brighter half counts, which leaves print out."""
    gaps, touching, inner_colours = [], 0, []
    shares = np.array([i / 24 * 0.7 + 0.15 for i in range(25)])
    for side in SIDES:
        low, high = frame.span(side)
        means, outside = [], 0.0
        for way in (_inward(side), -_inward(side)):
            across = frame.sides[side] + way * photo.depth * np.array([0.5, 1.0, 1.5])[:, None]
            px, py = frame.image(side, across, low + shares[None] * (high - low))
            outside = max(outside, photo.beyond(px, py).mean(1).max())
            at = photo.cells(px, py)
            lum = photo.lum[at]
            means.append(photo.rgb[at][lum >= np.median(lum)].mean(0))
        inner_colours.append(means[0])
        if outside > 0.3 or near_border(photo, frame, side):
            touching += 1
        else:
            gaps.append(float(np.abs(means[0] - means[1]).max()))
    apart = float(np.ptp(np.array(inner_colours), 0).max())
    return gaps, touching, min(max(1.0 - (apart - 12.0) / 30.0, 0.0), 1.0)


def has_inner_edge(photo: Photo, frame: Frame) -> bool:
    """A side on the photo's border has a long weak edge, nearly parallel, further in: the rectangle is too large."""
    tilts = np.array([math.tan(math.radians(-6.0 + 1.5 * i)) for i in range(9)])
    for side in SIDES:
        length = frame.length(side)
        first = 0.04 * length
        places = first + np.arange(max(0, math.ceil((0.65 * length - first) / 2.0))) * 2.0
        if not len(places) or not near_border(photo, frame, side):
            continue
        low, high = frame.span(side)
        along = low + _shares(0.12, 0.88, 40) * (high - low)
        lean = (along - 0.5 * (low + high))[None] * tilts[:, None]
        across = frame.sides[side] + _inward(side) * places[None, :, None] + lean[:, None, :]
        before, after = (photo.lum[photo.cells(*frame.image(side, across + d, np.broadcast_to(along, across.shape)))] for d in (-2.0, 2.0))
        step = np.abs(after - before)
        if ((step > 4.0) & (step < 45.0)).mean(2).max() > 0.88:
            return True
    return False


_JUDGED = "mask string, `rank` int, ang double, fill double, x0 double, x1 double, y0 double, y1 double, contrasts array<double>, touching int, purity double, `inner` boolean"


def judged_rectangles(rects: DataFrame, fine: DataFrame) -> DataFrame:
    """``rects`` (image_id, mask, rank, ang, x0, x1, y0, y1, fill, gw of the grid they were found on) scaled to the grids of
    ``fine`` (image_id, gw, gh, r, g, b), snapped there and judged: contrasts, touching, purity, inner, gw, gh.

    The rectangles of a photo, one per mask at most, meet its grid in one row; the grids move at most once."""
    row = F.struct("mask", F.col("rank").cast("int").alias("rank"), "ang", "fill", *SIDES, F.col("gw").alias("found_gw"))
    lists = rects.groupBy("image_id").agg(F.collect_list(row).alias("rects"))
    kind = fine.schema["image_id"].dataType.simpleString()

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, gw, gh, r, g, b, found in batch.itertuples(index=False):
                photo = Photo(gw, gh, r, g, b)
                for rect in found:
                    scale = gw / rect["found_gw"]
                    frame = snapped(photo, Frame(rect["ang"], {s: rect[s] * scale for s in SIDES}))
                    gaps, touching, purity = contrasts(photo, frame)
                    out.append((key, gw, gh, rect["mask"], rect["rank"], rect["ang"], rect["fill"], *(frame.sides[s] for s in SIDES), gaps, touching, purity, has_inner_edge(photo, frame)))
            yield pd.DataFrame(out, columns=["image_id", "gw", "gh", "mask", "rank", "ang", "fill", *SIDES, "contrasts", "touching", "purity", "inner"])

    return spread(fine.select("image_id", "gw", "gh", "r", "g", "b"), "image_id").join(lists, "image_id").mapInPandas(judge, f"image_id {kind}, gw int, gh int, {_JUDGED}")
