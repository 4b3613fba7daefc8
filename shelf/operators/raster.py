"""Images as tables of cells (image_id, y, x, values): windows, thresholds, masks.

A grid has a fixed longest side (96, 480 or 1600 cells), so one row of one image is a bounded window
partition and one image a bounded group; images spread over the cluster by ``image_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LUMA = (0.299, 0.587, 0.114)  # fixed values: weights of red, green, blue


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def _line_sums(df: DataFrame, by: list[str], along: str, columns: list[str], k: int) -> DataFrame:
    """Sums of ``k`` neighbours along one axis; beyond an end the end value repeats."""
    r = k // 2
    line = Window.partitionBy(*by)
    near = line.orderBy(along).rowsBetween(-r, k - 1 - r)
    whole = line.orderBy(along).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, low, high = F.col(along), F.min(along).over(whole), F.max(along).over(whole)
    before = F.greatest(F.lit(0), F.lit(r) - (at - low))
    after = F.greatest(F.lit(0), at + (k - 1 - r) - high)
    return df.withColumns({
        c: F.sum(c).over(near) + before * F.first(c).over(whole) + after * F.last(c).over(whole) for c in columns
    })


def by_image(df: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The cells of an image in one partition: all passes along its lines and columns then need no further shuffle."""
    return df.repartition(*by)


def window_sum(df: DataFrame, columns: list[str], k: int, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Sum over k x k cells with repeated borders, in two one-dimensional passes."""
    by = list(by)
    df = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return _line_sums(_line_sums(df, by + ["y"], "x", columns, k), by + ["x"], "y", columns, k)


def blur(df: DataFrame, columns: list[str], k: int, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return window_sum(df, columns, k, by).withColumns({c: F.col(c) / (k * k) for c in columns})


def _shrink_or_grow(masks: DataFrame, k: int, by: tuple[str, ...], grow: bool, column: str) -> DataFrame:
    summed = window_sum(masks, [column], k, by)
    limit = 0.5 if grow else k * k - 0.5
    return summed.withColumn(column, F.col(column) > limit)


def erode(masks: DataFrame, k: int, by: tuple[str, ...] = ("image_id",), column: str = "on") -> DataFrame:
    return _shrink_or_grow(masks.withColumn(column, F.col(column).cast("int")), k, by, False, column)


def dilate(masks: DataFrame, k: int, by: tuple[str, ...] = ("image_id",), column: str = "on") -> DataFrame:
    return _shrink_or_grow(masks.withColumn(column, F.col(column).cast("int")), k, by, True, column)


def open_close(masks: DataFrame, side: int, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Remove specks, then close gaps; window sizes follow the short side of the grid."""
    k_open = max(3, int(side * 0.015)) | 1
    k_close = max(5, int(side * 0.03)) | 1
    opened = dilate(erode(by_image(masks, by), k_open, by), k_open, by)
    return erode(dilate(opened, k_close, by), k_close, by)


def otsu(cells: DataFrame, column: str = "lum", by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(``by``…, threshold): the first of 256 bins over 0-255 that best parts dark from bright.

    A bin without values has the same split as the filled bin before it, so only filled bins are
    looked at. A constant image has no split and gives the centre of bin 0; no values give 127.
    """
    by = list(by)
    bins = cells.groupBy(*by).agg(F.count_if(F.col(column).between(0, 255)).alias("_all"))
    filled = (
        cells.filter(F.col(column).between(0, 255))
        .withColumn("bin", F.least(F.floor(F.col(column) * (256 / 255.0)), F.lit(255)))
        .groupBy(*by, "bin").agg(F.count("*").cast("double").alias("n"))
        .withColumn("center", (F.col("bin") + 0.5) * (255.0 / 256))
    )
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    mass = F.col("n") * F.col("center")
    split = filled.select(
        *by, "bin", "center",
        F.sum("n").over(upto).alias("w0"), F.sum(mass).over(upto).alias("s0"),
        F.sum("n").over(every).alias("w"), F.sum(mass).over(every).alias("s"),
    )
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.greatest(F.col("w0"), F.lit(1)) - (F.col("s") - F.col("s0")) / F.greatest(w1, F.lit(1))
    between = F.when(w1 == 0, 0.0).otherwise(F.col("w0") * w1 * gap * gap)
    best = split.withColumn("between", between).groupBy(*by).agg(
        F.max_by("center", F.struct("between", (-F.col("bin")).alias("first"))).alias("center"),
        F.max("between").alias("between"),
    )
    return bins.join(best, by, "left").select(
        *by,
        F.when(F.col("_all") == 0, 127.0).when(F.col("between") == 0, 0.5 * 255 / 256).otherwise(F.col("center")).alias("threshold"),
    )


def grid_sizes(cells: DataFrame, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return cells.groupBy(*by).agg((F.max("x") + 1).alias("gw"), (F.max("y") + 1).alias("gh"))


def with_border(cells: DataFrame) -> DataFrame:
    """Add ``border``: the cell lies in the outer frame, 4 % of the short side and 3 cells at least."""
    whole = Window.partitionBy("image_id")
    w, h = F.max("x").over(whole) + 1, F.max("y").over(whole) + 1
    frame = F.greatest(F.lit(3), (F.least(w, h) * 0.04).cast("int"))
    x, y = F.col("x"), F.col("y")
    return cells.withColumn("border", (x < frame) | (y < frame) | (x >= w - frame) | (y >= h - frame))


def border_colors(cells: DataFrame) -> DataFrame:
    """(image_id, bg_r, bg_g, bg_b, spread): median colour of the frame and median distance to it."""
    frame = with_border(cells).filter("border")
    bg = frame.groupBy("image_id").agg(*[F.median(c).alias(f"bg_{c}") for c in "rgb"])
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"bg_{c}")) for c in "rgb"])
    spread = frame.join(bg, "image_id").groupBy("image_id").agg(F.median(off).alias("spread"))
    return bg.join(spread, "image_id")


def candidate_masks(cells: DataFrame, tolerance: float = 28) -> DataFrame:
    """(image_id, mask, rank, y, x, on): guesses at what is paper, from blurred r, g, b cells.

    bright: the side of the Otsu split that the frame mostly is not; contrast and contrast-low: far
    from the frame's colour; chroma: another hue than the frame.
    """
    cells = with_border(cells.withColumn("lum", luma(F.col("r"), F.col("g"), F.col("b"))))
    cells = cells.withColumns({"rg": F.col("r") - F.col("g"), "gb": F.col("g") - F.col("b")})
    stats = cells.filter("border").groupBy("image_id").agg(
        *[F.median(c).alias(f"bg_{c}") for c in ("r", "g", "b", "rg", "gb")]
    )
    levels = otsu(cells)
    cells = cells.join(stats.join(levels, "image_id"), "image_id").withColumns({
        "diff": F.greatest(*[F.abs(F.col(c) - F.col(f"bg_{c}")) for c in "rgb"]),
        "hue": F.greatest(F.abs(F.col("rg") - F.col("bg_rg")), F.abs(F.col("gb") - F.col("bg_gb"))),
        "light": F.col("lum") > F.col("threshold"),
    })
    on_frame = cells.filter("border").groupBy("image_id").agg(
        F.median("diff").alias("spread"), F.median("hue").alias("hue_spread"),
        F.avg(F.col("light").cast("int")).alias("light_frame"),
    )
    cells = cells.join(on_frame, "image_id")
    spread = F.col("spread")
    masks = {
        "bright": F.when(F.col("light_frame") <= 0.5, F.col("light")).otherwise(~F.col("light")),
        "contrast": F.col("diff") > F.greatest(F.lit(float(tolerance)), 4.0 * spread),
        "contrast-low": F.col("diff") > F.greatest(F.lit(8.0), F.lit(0.4 * tolerance), 3.0 * spread),
        "chroma": F.col("hue") > F.greatest(F.lit(10.0), 4.0 * F.col("hue_spread")),
    }
    rows = F.array(*[
        F.struct(F.lit(name).alias("mask"), F.lit(i).alias("rank"), on.alias("on")) for i, (name, on) in enumerate(masks.items())
    ])
    return cells.select("image_id", "y", "x", F.inline(rows)).select("image_id", "mask", "rank", "y", "x", "on")


def gradients(cells: DataFrame) -> DataFrame:
    """Add ``grad``: largest step of any colour to the left or upper neighbour, on twice blurred cells."""
    smooth = blur(by_image(cells), ["r", "g", "b"], 3)

    def step(along: str, across: str) -> Column:
        line = Window.partitionBy("image_id", across).orderBy(along)
        return F.greatest(*[F.abs(F.col(c) - F.coalesce(F.lag(c).over(line), F.col(c))) for c in "rgb"])

    stepped = smooth.withColumn("_gx", step("x", "y")).withColumn("_gy", step("y", "x"))
    return stepped.withColumn("grad", F.greatest("_gx", "_gy")).drop("_gx", "_gy")


def edge_lines(cells: DataFrame) -> DataFrame:
    """(image_id, mask, rank, y, x, on): where strong gradients, thickened, mark an outline."""
    strong = gradients(cells).select(
        "image_id", "y", "x",
        F.inline(F.array(*[
            F.struct(F.lit("edges").alias("mask"), F.lit(rank).alias("rank"), (F.col("grad") > thr).alias("on"))
            for rank, thr in ((4, 2.5), (5, 4.0))
        ])),
    )
    return dilate(strong, 5, ("image_id", "mask", "rank")).select("image_id", "mask", "rank", "y", "x", "on")
