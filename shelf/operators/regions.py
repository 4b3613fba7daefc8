"""Connected regions of masks and the rectangles around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from shelf.session import write_down

KEY = ("image_id", "mask", "rank")
_ROW = 1 << 20  # larger than any grid side


def label_regions(masks: DataFrame, by: tuple[str, ...] = KEY, column: str = "on") -> DataFrame:
    """Add ``region`` to the set cells: 4-connected regions, named by their first cell in reading
    order (y * 2^20 + x).

    Cells in a row first merge into runs, so the graph of an image has one node per run and an edge
    where runs of neighbouring rows overlap. A grid bounds that graph, so each image's runs are
    joined up in one task, in a single shuffle for all images.
    """
    by = list(by)
    row = Window.partitionBy(*by, "y").orderBy("x")
    cells = masks.withColumn("_starts", F.col(column) & ~F.coalesce(F.lag(column).over(row), F.lit(False)))
    cells = cells.filter(column).withColumn(
        "_x0", F.max(F.when(F.col("_starts"), F.col("x"))).over(row.rowsBetween(Window.unboundedPreceding, 0))
    )
    cells = write_down(cells.withColumn("_run", F.col("y").cast("long") * _ROW + F.col("_x0")).drop("_starts"), "cells")
    runs = cells.groupBy(*by, "y", F.col("_run").alias("run")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    above = runs.select(*by, (F.col("y") + 1).alias("y"), F.col("run").alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    touching = runs.join(above, by + ["y"]).filter("x0 <= a1 and a0 <= x1")
    schema = T.StructType([masks.schema[c] for c in by] + [T.StructField("_run", T.LongType()), T.StructField("component", T.LongType())])
    found = touching.select(*by, "run", "a").groupBy(*by).applyInPandas(_join_runs(by), schema)
    return (
        cells.join(found, by + ["_run"], "left")
        .withColumn("region", F.coalesce("component", "_run"))
        .drop("_x0", "_run", "component")
    )


def joined_labels(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest that edges lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[one], label[two])
        lower = label.copy()
        for end in (label[one], label[two], one, two):
            np.minimum.at(lower, end, low)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _join_runs(by: list[str]):
    """Component (its smallest run) of every run of one image, by lowering labels along edges."""

    def join(edges: pd.DataFrame) -> pd.DataFrame:
        runs, ends = np.unique(edges[["run", "a"]].to_numpy(), return_inverse=True)
        found = pd.DataFrame({"_run": runs, "component": runs[joined_labels(len(runs), *ends.reshape(-1, 2).T)]})
        for i, name in enumerate(by):
            found.insert(i, name, edges[name].iloc[0])
        return found

    return join


def touching_border(regions: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """(``by``…, region) of regions with a cell on the outermost line; needs gw and gh columns."""
    edge = "x = 0 or y = 0 or x = gw - 1 or y = gh - 1"
    return regions.filter(edge).select(*by, "region").distinct()


def fill_holes(masks: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """Set every cell that the border cannot reach over unset cells."""
    outside = label_regions(masks.withColumn("on", ~F.col("on")), by)
    reached = outside.join(touching_border(outside, by), [*by, "region"], "left_semi").select(*by, "y", "x", F.lit(True).alias("_out"))
    return masks.join(reached, [*by, "y", "x"], "left").withColumn("on", F.col("_out").isNull()).drop("_out")


def largest_region(masks: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """Only the largest region of each mask; the first in reading order among equals."""
    regions = write_down(label_regions(masks, by), "regions")
    sizes = regions.groupBy(*by, "region").agg(F.count("*").alias("size"))
    best = sizes.groupBy(*by).agg(F.max_by("region", F.struct("size", (-F.col("region")).alias("first"))).alias("region"))
    return regions.join(best, [*by, "region"], "left_semi").drop("region")


def min_area_rectangles(regions: DataFrame, by: tuple[str, ...] = KEY) -> DataFrame:
    """(``by``…, area, ang, x0, x1, y0, y1, fill) of regions that cover 2 % of the image or more.

    The smallest rectangle over turns of -45 to 45 degrees in half degrees, the first among equals;
    a turn below one degree counts as none. Corner points of the first and last cell of each row and
    column are enough to bound a region.
    """
    by = list(by)

    def ends(line: str, along: str) -> DataFrame:
        spans = regions.groupBy(*by, line).agg(F.min(along).alias("lo"), (F.max(along) + 1).alias("hi"))
        corners = F.array(*[
            F.struct(*[c.alias(n) for c, n in zip((F.col(end), F.col(line) + d), (along, line))])
            for end in ("lo", "hi") for d in (0, 1)
        ])
        return spans.select(*by, F.inline(corners)).select(*by, "x", "y")

    corners = ends("y", "x").unionByName(ends("x", "y")).groupBy(*by).agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))
    areas = regions.groupBy(*by).agg(F.count("*").alias("area"), F.max("gw").alias("gw"), F.max("gh").alias("gh"))
    return smallest_rectangles(areas.join(corners, by), by)


def smallest_rectangles(bounded: DataFrame, by: tuple[str, ...] | list[str] = KEY) -> DataFrame:
    """The rectangles of :func:`min_area_rectangles` for regions (``by``…, area, gw, gh) with the corners ``xs``, ``ys`` that
    bound them, one row each. All turns of a region are tried in its row."""
    by = list(by)
    turn = F.radians((F.col("id") - 90) / 2.0)
    table = bounded.sparkSession.range(181).select("id", F.cos(turn), F.sin(turn)).collect()  # one row per turn
    cos, sin = (np.array([row[k] for row in sorted(table)])[:, None] for k in (1, 2))
    kept = bounded.filter(F.col("area") >= 0.02 * F.col("gw") * F.col("gh")).select(*by, "area", "gw", "gh", "xs", "ys")
    schema = T.StructType([kept.schema[c] for c in (*by, "area", "gw", "gh")] + [T.StructField("step", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("x0", "x1", "y0", "y1")])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for xs, ys in zip(batch["xs"], batch["ys"]):
                x, y = np.asarray(xs, np.float64), np.asarray(ys, np.float64)
                xr, yr = x * cos + y * sin, -x * sin + y * cos
                x0, x1, y0, y1 = xr.min(1), xr.max(1), yr.min(1), yr.max(1)
                step = int(((x1 - x0) * (y1 - y0)).argmin())
                step = 90 if abs(step - 90) < 2 else step
                found.append((step, x0[step], x1[step], y0[step], y1[step]))
            frames = pd.DataFrame(found, columns=["step", "x0", "x1", "y0", "y1"], index=batch.index)
            yield pd.concat([batch.drop(columns=["xs", "ys"]), frames], axis=1)

    rect = kept.mapInPandas(fit, schema)
    full = F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return rect.select(
        *by, "area", F.radians((F.col("step") - 90) / 2.0).alias("ang"), "x0", "x1", "y0", "y1",
        F.least(F.lit(1.0), F.col("area") / full).alias("fill"), "gw", "gh",
    )


def frame_quad(ang: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Corners in image coordinates of a rectangle given in its turned frame."""
    c, s = F.cos(ang), F.sin(ang)

    def corner(x: Column, y: Column) -> Column:
        return F.struct((x * c - y * s).alias("x"), (x * s + y * c).alias("y"))

    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))
