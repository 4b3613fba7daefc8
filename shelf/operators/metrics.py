"""How good found boxes are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelf.operators.crop import CONF_OK
from shelf.operators.quantiles import exact_medians
from shelf.session import spread

# Grades of the shared area.
GOOD, FAIR, RIGHT = 0.93, 0.85, 0.90


#: Grid lines that are looked at together.
LINES = 1 << 20


def _runs(corners: np.ndarray, y: np.ndarray, scale: float, cols: np.ndarray) -> np.ndarray:
    """[4, line]: where the sides of quads [4 corners, x and y, line] cross the lines ``y``, as the first cell whose centre lies at or
    beyond the crossing, from left to right. Inside the quad, by the even-odd rule, are the cells from the first to before
    the second, and from the third to before the fourth; runs that are not there are empty."""
    cells = np.full((4, len(y)), np.iinfo(np.int64).max)
    for i in range(4):
        (ax, ay), (bx, by) = corners[i], corners[(i + 1) % 4]
        at = ax + (y - ay) * (bx - ax) / np.where(by == ay, 1.0, by - ay)
        crosses = (ay > y) != (by > y)
        cells[i, crosses] = np.clip(np.ceil(at[crosses] * scale - 0.5), 0, cols[crosses]).astype(np.int64)
    cells.sort(axis=0)
    cells[cells == np.iinfo(np.int64).max] = 0
    return cells


def _counted(batches: Iterator[pa.RecordBatch], scale: float, key: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols, rows = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cols", "rows"))
        quads = [np.stack([np.stack([batch.column(f"{q}{i}{c}").to_numpy(zero_copy_only=False).astype(np.float64) for c in "xy"]) for i in range(4)]) for q in "ab"]
        iou, first = np.zeros(len(cols)), 0
        upto = np.cumsum(rows)
        while first < len(cols):  # photos of about LINES lines, one at least
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + LINES, "right")))
            own = np.repeat(np.arange(first, last), rows[first:last])
            line = np.arange(len(own)) - np.repeat(np.cumsum(rows[first:last]) - rows[first:last], rows[first:last])
            a, b = (_runs(q[:, :, own], (line + 0.5) / scale, scale, cols[own]) for q in quads)
            shared = sum(np.maximum(0, np.minimum(a[i + 1], b[j + 1]) - np.maximum(a[i], b[j])) for i in (0, 2) for j in (0, 2))
            each = sum(x[i + 1] - x[i] for x in (a, b) for i in (0, 2))
            at = np.arange(first, last)
            both, size = (np.bincount(own, x, minlength=last)[at] for x in (shared, each))
            iou[at] = np.where(size > 0, both / np.maximum(size - both, 1), 0.0)
            first = last
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(iou)], [key, "iou"])


def quad_iou(pairs: DataFrame, scale: float = 0.25, key: str = "case_id") -> DataFrame:
    """(``key``, iou) of two quads ``a`` and ``b`` in photos of w x h, counted on a grid of cell
    centres at ``scale``; 0 when both are empty. Photos stay rows: the lines of their grids are counted from where the sides
    cross them, many photos at a time."""
    cols, rows = (F.greatest(F.lit(1), (F.col(c) * scale).cast("int")) for c in ("w", "h"))
    corners = [F.col(q)[i][c].cast("double").alias(f"{q}{i}{c}") for q in "ab" for i in range(4) for c in "xy"]
    kind = pairs.schema[key].dataType.simpleString()
    flat = spread(pairs, key).select(key, cols.alias("cols"), rows.alias("rows"), *corners)
    return flat.mapInArrow(lambda batches: _counted(batches, scale, key), f"`{key}` {kind}, iou double")


def grade(iou: Column | str) -> Column:
    iou = F.col(iou) if isinstance(iou, str) else iou
    return F.when(iou >= GOOD, "OK").when(iou >= FAIR, "~").otherwise("BAD")


def accuracy_summary(cases: DataFrame) -> DataFrame:
    """One row over cases (iou, conf): mean, median, shares of grades, and how flags fit results."""
    _, middle = exact_medians(cases, ["iou"])
    iou, flagged = F.col("iou"), F.col("conf") < CONF_OK
    right = iou >= RIGHT

    def share(condition: Column) -> Column:
        return F.avg(condition.cast("int"))

    return cases.agg(
        F.count("*").alias("cases"), F.avg("iou").alias("mean_iou"), F.lit(middle["iou"]).alias("median_iou"),
        share(iou >= GOOD).alias("good"), share(right).alias("right"), share(iou < FAIR).alias("bad"),
        F.count_if(~right).alias("wrong"), F.count_if(~right & flagged).alias("wrong_flagged"),
        F.count_if(right & flagged).alias("right_flagged"),
    )


def accuracy_by_kind(cases: DataFrame) -> DataFrame:
    return cases.groupBy("kind").agg(
        F.count("*").alias("n"), F.avg("iou").alias("mean_iou"), F.min("iou").alias("min_iou")
    )


def worst_cases(cases: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` cases with the smallest shared area."""
    return cases.orderBy("iou", "case_id").limit(n)
