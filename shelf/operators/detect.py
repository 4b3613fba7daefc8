"""Find the sheet in each photo of a grid table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelf.functions.geometry import confidence_score
from shelf.operators import edges, grids, raster
from shelf.operators.fine import judged_rectangles
from shelf.operators.regions import KEY, fill_holes, frame_quad, largest_region, min_area_rectangles, smallest_rectangles
from shelf.session import spread, write_down

# Limits of confidence, and how near to the paper's colour a cell must be, strict first.
CONF_OK = 0.70
SURE = 0.97
PAPER_GAPS = (6.0, 10.0, 16.0, 24.0)
SMALLEST_SIDE = 16


def image_arrays(cells: DataFrame) -> DataFrame:
    """(image_id, gw, gh, r, g, b, lum): each grid as flat arrays in reading order (a bounded size)."""
    values = {c: F.transform("_cells", _field(c)) for c in "rgb"}
    lum = F.transform("_cells", lambda c: raster.luma(c["r"], c["g"], c["b"]))
    return _packed(cells).select("image_id", "gw", "gh", *[v.alias(c) for c, v in values.items()], lum.alias("lum"))


def _packed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("image_id").agg(
        (F.max("x") + 1).alias("gw"), (F.max("y") + 1).alias("gh"),
        F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("_cells"),
    )


def _field(name: str):
    return lambda c: c[name]


def clean_regions(masks: DataFrame, sizes: DataFrame) -> DataFrame:
    """The one region each mask stands for: specks removed, gaps closed, holes filled, largest kept."""
    sized = write_down(masks.join(sizes, "image_id"), "masks")
    short = F.least("gw", "gh")
    # grids have a fixed longest side, so there are only a few different short sides to open and close by
    sides = [row[0] for row in sized.select(short).distinct().collect()]
    windows: dict[tuple[int, int], list[int]] = {}
    for side in sides:
        windows.setdefault((int(side * 0.015), int(side * 0.03)), []).append(side)
    cleaned = None
    for group in windows.values():
        part = raster.open_close(sized.filter(short.isin(group)), group[0], KEY)
        cleaned = part if cleaned is None else cleaned.unionByName(part)
    if cleaned is None:
        cleaned = sized
    filled = write_down(fill_holes(write_down(cleaned, "closed")), "filled")
    # a mask that opening emptied has no region at all, whatever filling makes of it
    alive = filled.groupBy(*KEY).agg(F.max("on").alias("_any")).filter("_any").select(*KEY)
    return write_down(largest_region(filled.join(alive, list(KEY), "left_semi")), "regions")


def score_regions(regions: DataFrame, arrays: DataFrame, fine: DataFrame | None = None) -> DataFrame:
    """One row per region: its rectangle, snapped to edges, with confidence and evidence; in cells of ``fine`` where finer
    grids are given."""
    if fine is not None:
        return _scored(write_down(judged_rectangles(min_area_rectangles(regions), fine), "judged"))
    rects = spread(min_area_rectangles(regions).drop("gw", "gh"), "image_id").join(arrays, "image_id")
    snapped = write_down(edges.snap_sides(rects), "snapped")
    judged = write_down(edges.side_contrasts(snapped), "contrasts")
    judged = edges.inner_edge(judged).drop("r", "g", "b", "lum")
    return _scored(write_down(judged, "inner"))


def _judged(regions: DataFrame, judging: DataFrame) -> DataFrame:
    """One row per region of whole grids, scored on the grids of ``judging``; sampling is the same on either table."""
    return _scored(write_down(judged_rectangles(smallest_rectangles(grids.region_corners(regions)), judging), "judged"))


def _scored(judged: DataFrame) -> DataFrame:
    frac = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("gw") * F.col("gh"))
    score = confidence_score(F.col("fill"), F.least(F.col("frac"), F.lit(1.0)), F.col("contrasts"), F.col("purity"))
    return judged.withColumn("frac", frac).withColumn("conf", score * F.when(F.col("inner"), 0.5).otherwise(1.0))


def _best(scored: DataFrame) -> DataFrame:
    row = F.struct(*[c for c in scored.columns if c != "image_id"])
    return scored.groupBy("image_id").agg(
        F.max_by(row, F.struct("conf", (-F.col("rank")).alias("first"))).alias("best")
    ).select("image_id", "best.*")


def paper_masks(blurred: DataFrame, regions: DataFrame) -> DataFrame:
    """Masks of all cells near the paper's colour, the median of a region's brighter half."""
    inside = blurred.withColumn("lum", raster.luma(F.col("r"), F.col("g"), F.col("b"))).join(
        regions.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi"
    )
    level = inside.groupBy("image_id").agg(F.median("lum").alias("level"))
    paper = inside.join(level, "image_id").filter("lum >= level").groupBy("image_id").agg(
        *[F.median(c).alias(f"p_{c}") for c in "rgb"]
    )
    gap = F.greatest(*[F.abs(F.col(c) - F.col(f"p_{c}")) for c in "rgb"])
    rows = F.array(*[
        F.struct(F.lit("paper-colour").alias("mask"), F.lit(6 + i).alias("rank"), (F.col("gap") < limit).alias("on"))
        for i, limit in enumerate(PAPER_GAPS)
    ])
    return blurred.join(paper, "image_id").withColumn("gap", gap).select("image_id", "y", "x", F.inline(rows))


def detect_documents(cells: DataFrame, tolerance: float = 28, fine: DataFrame | None = None) -> DataFrame:
    """One row per image of a grid table (image_id, y, x, r, g, b): quad in grid cells, conf, method,
    angle in degrees, frac, warnings, bg, gw, gh; quad is null when nothing was found.

    Regions are found on these cells. With ``fine``, one row per image (image_id, gw, gh, r, g, b as flat arrays) of finer
    grids, sides are snapped and judged there, and quad, gw and gh are in its cells. An image without a fine grid has no box.

    All masks of all images are evaluated together, the paper-colour pass only for images whose best
    region so far is not sure. Boxes are as fine as the grid that judges them.
    """
    place = F.transform("_cells", lambda c: c["y"] * F.col("gw") + c["x"])
    gaps = F.exists("_cells", lambda c: c["r"].isNull() | c["g"].isNull() | c["b"].isNull())
    whole = (F.col("gw") > 0) & (F.col("gh") > 0) & ~gaps & (place == F.sequence(F.lit(0), F.col("gw") * F.col("gh") - 1))
    # images without an id only keep their size
    packed = _packed(cells).withColumn("whole", F.coalesce(F.col("image_id").isNull() | whole, F.lit(False)))
    packed = write_down(packed.select("image_id", "gw", "gh", "whole", *[F.transform("_cells", _field(c)).alias(c) for c in "rgb"]), "packed")
    found = detect_in_grids(packed.filter("whole").drop("whole"), tolerance, fine)
    odd = packed.filter("not whole").select("image_id")
    if odd.isEmpty():
        return found
    return found.unionByName(_detect_in_cells(cells.join(odd, "image_id", "left_semi"), tolerance, fine))


def detect_in_grids(arrays: DataFrame, tolerance: float = 28, fine: DataFrame | None = None) -> DataFrame:
    """The rows of :func:`detect_documents` for whole grids, one row per image (image_id, gw, gh, r, g, b as flat arrays)."""
    sizes = arrays.select("image_id", "gw", "gh")
    big = arrays.filter("image_id is not null").filter(F.least("gw", "gh") >= SMALLEST_SIDE)
    blurred = write_down(grids.blur(spread(big), 3), "blurred")
    judging = big if fine is None else fine
    masks = grids.candidate_masks(blurred, tolerance).unionByName(grids.fill_holes(grids.edge_lines(blurred)))
    regions = write_down(grids.clean_regions(masks), "regions")
    scored = write_down(_judged(regions, judging), "scored")
    first = write_down(_best(scored), "first")
    unsure = first.filter(F.col("conf") < SURE).select("image_id", "mask", "rank")
    seen = regions.join(unsure, list(KEY), "left_semi")
    paper = grids.clean_regions(grids.paper_masks(blurred, seen, PAPER_GAPS))
    again = _judged(paper, judging)
    return _reported(sizes, first.unionByName(again), blurred.select("image_id", "bg_r", "bg_g", "bg_b"), fine)


def _detect_in_cells(cells: DataFrame, tolerance: float, fine: DataFrame | None) -> DataFrame:
    """The rows of :func:`detect_documents` for grids with cells missing or repeated."""
    sizes = raster.grid_sizes(cells)
    big = write_down(sizes.filter(F.least("gw", "gh") >= SMALLEST_SIDE), "sizes")
    # a side below 16 cells is too small to look at
    cells = cells.join(big.select("image_id"), "image_id", "left_semi")
    blurred = write_down(raster.blur(cells, ["r", "g", "b"], 3), "blurred")
    arrays = write_down(image_arrays(cells), "arrays") if fine is None else None
    lines = write_down(raster.edge_lines(blurred).join(big, "image_id"), "lines")
    outlined = fill_holes(lines).select("image_id", "mask", "rank", "y", "x", "on")
    masks = raster.candidate_masks(blurred, tolerance).unionByName(outlined)
    regions = clean_regions(masks, big)
    scored = write_down(score_regions(regions, arrays, fine), "scored")
    first = write_down(_best(scored), "first")
    unsure = first.filter(F.col("conf") < SURE).select("image_id", "mask", "rank")
    seen = regions.join(unsure, list(KEY), "left_semi")
    paper = paper_masks(blurred.join(unsure.select("image_id"), "image_id", "left_semi"), seen)
    again = score_regions(clean_regions(paper, big), arrays, fine)
    return _reported(sizes, first.unionByName(again), raster.border_colors(blurred), fine)


def _reported(sizes: DataFrame, scored: DataFrame, colors: DataFrame, fine: DataFrame | None) -> DataFrame:
    """The best region of each image as :func:`detect_documents` gives it."""
    best = _best(scored)
    degrees = F.degrees("ang")

    def flag(condition: Column, name: str) -> Column:
        return F.when(condition, F.lit(name))

    found = F.col("conf").isNotNull()
    full = (F.col("frac") > 0.97) | (F.col("touching") >= 4)
    warnings = F.array_compact(F.array(
        flag(F.least("gw", "gh") < SMALLEST_SIDE, "too_small"),
        flag(~found & (F.least("gw", "gh") >= SMALLEST_SIDE), "nothing_found"),
        flag(F.col("conf") < CONF_OK, "low_confidence"),
        flag(F.col("inner"), "inner_edge"),
        flag(F.col("frac") < 0.15, "small_document"),
        flag(full, "full_frame"),
        flag(~full & (F.col("touching") >= 1), "touches_edge"),
        flag(F.abs(degrees) > 3.0, "tilted"),
    ))
    bg = F.array(*[F.col(f"bg_{c}").cast("int") for c in "rgb"])
    if fine is not None:
        sizes = sizes.drop("gw", "gh").join(fine.select("image_id", "gw", "gh"), "image_id", "left")
    return (
        sizes.join(best.drop("gw", "gh"), "image_id", "left")
        .join(colors, "image_id", "left")
        .select(
            "image_id",
            F.when(found, frame_quad(F.col("ang"), F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"))).alias("quad"),
            F.coalesce("conf", F.lit(0.0)).alias("conf"),
            F.coalesce("mask", F.lit("none")).alias("method"),
            F.coalesce(degrees, F.lit(0.0)).alias("angle"),
            F.least(F.coalesce("frac", F.lit(0.0)), F.lit(1.0)).alias("frac"),
            warnings.alias("warnings"),
            F.coalesce(F.when(F.col("bg_r").isNotNull(), bg), F.array(*[F.lit(255)] * 3)).alias("bg"),
            "gw", "gh",
        )
    )
