"""A locator learned from taught boxes: cell features, a forest, the best rectangle."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelf.functions.geometry import box, iou
from shelf.operators import raster
from shelf.operators.numbering import row_numbers
from shelf.session import write_down

# Fixed values of the model.
MIN_PHOTOS = 3
MODEL_VERSION = 3
TREES, DEPTH, MIN_LEAF, CELLS_PER_TREE = 24, 8, 20, 22_000
FEATURES = ("r", "g", "b", "lum", "std", "sat", "ink", "blue", "gx", "gy", "rise")


def cell_features(pixels: DataFrame, cell: int = 6) -> DataFrame:
    """(image_id, y, x, features): 38 numbers for each block of ``cell`` x ``cell`` pixels.

    Colours, brightness and its deviation, saturation, ink (clearly darker than its surroundings),
    blue ink, gradients and brightness against a wide mean; each also blurred over 5 and 13 cells;
    brightness, saturation and ink against the photo's median; the place in the photo.
    """
    r, g, b, lum = (F.col(c) for c in ("r", "g", "b", "lum"))
    lit = pixels.withColumn("lum", raster.luma(r, g, b))
    around = raster.blur(lit.withColumn("wide", lum), ["wide"], 25)

    def step(along: str, across: str) -> Column:
        line = Window.partitionBy("image_id", across).orderBy(along)
        return F.abs(lum - F.coalesce(F.lag("lum").over(line), lum))

    top, low = F.greatest(r, g, b), F.least(r, g, b)
    marked = around.withColumns({
        "sat": (top - low) / (top + 1.0),
        "ink": (lum < F.col("wide") - 30).cast("double"),
        "blue": ((b > r + 20) & (b > g + 8) & (lum < 215)).cast("double"),
        "gx": step("x", "y"), "gy": step("y", "x"),
    })
    blocks = marked.groupBy(
        "image_id", F.floor(F.col("y") / cell).cast("int").alias("y"), F.floor(F.col("x") / cell).cast("int").alias("x")
    ).agg(
        *[F.avg(c).alias(c) for c in ("r", "g", "b", "lum", "sat", "ink", "blue", "gx", "gy")],
        F.avg(lum * lum).alias("sq"), F.avg(F.least(lum, F.lit(255.0))).alias("capped"),
    )
    blocks = write_down(
        blocks.withColumn("std", F.sqrt(F.greatest(F.col("sq") - lum * lum, F.lit(0.0)))), "blocks"
    )
    wide = raster.blur(blocks.withColumn("lum6", lum), ["lum6"], 13)
    base = write_down(wide.withColumn("rise", F.col("capped") - F.col("lum6")).drop("sq", "capped", "lum6"), "base")
    named = base.withColumns({f"{f}_{k}": F.col(f) for f in FEATURES for k in (5, 13)})
    for k in (5, 13):
        named = raster.blur(named, [f"{f}_{k}" for f in FEATURES], k)
    middle = base.groupBy("image_id").agg(
        *[F.median(f).alias(f"m_{f}") for f in ("lum", "sat", "ink")],
        F.greatest(F.lit(1), F.max("x")).alias("mx"), F.greatest(F.lit(1), F.max("y")).alias("my"),
    )
    columns = [F.col(c) for f in FEATURES for c in (f, f"{f}_5", f"{f}_13")]
    columns += [F.col(f) - F.col(f"m_{f}") for f in ("lum", "sat", "ink")]
    columns += [F.col("x") / F.col("mx"), F.col("y") / F.col("my")]
    return named.join(middle, "image_id").select(
        "image_id", "y", "x", F.array(*[c.cast("double") for c in columns]).alias("features")
    )


def cell_labels(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Add ``label``: 1 inside the taught box (struct box, as fractions), 0 outside; cells that
    straddle its edge are dropped. ``cells`` has gw and gh."""
    joined = cells.join(boxes.select("image_id", "box"), "image_id")

    def shared(at: str, size: str, low: str, high: str) -> Column:
        begin, end = F.col(at) / F.col(size), (F.col(at) + 1) / F.col(size)
        return F.greatest(F.lit(0.0), F.least(end, F.col(f"box.{high}")) - F.greatest(begin, F.col(f"box.{low}"))) * F.col(size)

    cover = shared("x", "gw", "l", "r") * shared("y", "gh", "t", "b")
    return (
        joined.withColumn("label", F.when(cover > 0.8, 1.0).when(cover < 0.2, 0.0))
        .filter("label is not null")
        .drop("box")
    )


def train(labelled: DataFrame, photos: int) -> RandomForestClassificationModel | None:
    """A forest over labelled cells, or None for fewer than three photos.

    Spark's random forest stands in for extremely randomised trees; judge it by the boxes it finds.
    """
    if photos < MIN_PHOTOS:
        return None
    rows = write_down(labelled.select("features", "label"), "training")
    count = rows.count()
    vectors = rows.select(array_to_vector("features").alias("features"), "label")
    mtry = max(4, int(math.sqrt(38)) + 2)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=MIN_LEAF, featureSubsetStrategy=str(mtry),
        subsamplingRate=min(1.0, CELLS_PER_TREE / max(1, count)), seed=0,
    )
    return forest.fit(vectors)


def cell_probabilities(model: RandomForestClassificationModel, cells: DataFrame) -> DataFrame:
    """(image_id, y, x, p): chance that a cell belongs to the document."""
    scored = model.transform(cells.withColumn("features", array_to_vector("features")))
    return scored.select("image_id", "y", "x", vector_to_array("probability")[1].alias("p"))


#: Cells times column pairs of one stretch of left columns that are looked at together.
PAIR_CELLS = 1 << 22


def _best_rectangle(score: np.ndarray) -> tuple[int, int, int, int, float]:
    """(l, t, r, b, gain) of a grid of scores [row, column]; see :func:`best_rectangles`."""
    h, w = score.shape
    totals = np.concatenate([np.zeros((h, 1)), np.cumsum(score, 1)], 1)
    best: tuple[float, int, int, int, int] | None = None
    step = max(1, PAIR_CELLS // (h * w))
    for l0 in range(0, w, step):
        left, right = np.triu_indices(w + 1, 1)
        mine = (left >= l0) & (left < l0 + step)
        left, right = left[mine], right[mine]
        down = np.cumsum(totals[:, right] - totals[:, left], 0)
        before = np.concatenate([np.zeros((1, len(left))), down[:-1]])
        low = np.minimum.accumulate(before, 0)
        gain = down - low
        fresh = np.concatenate([np.ones((1, len(left)), bool), before[1:] < low[:-1]])  # the earliest of equal minima
        top = np.maximum.accumulate(np.where(fresh, np.arange(h)[:, None], 0), 0)
        most = gain.max()
        if best is None or most > best[0]:
            pair = int((gain == most).any(0).argmax())  # pairs are in order of left, then right
            y = int((gain[:, pair] == most).argmax())
            best = (float(most), int(left[pair]), int(right[pair]), y, int(top[y, pair]))
    gain_, l, r, y, t = best
    return l, t, r, y + 1, gain_


def best_rectangles(scores: DataFrame, column: str = "score") -> DataFrame:
    """(image_id, l, t, r, b, gain): the rectangle with the largest sum of cells, r and b exclusive.

    Sums of a row between two columns come from its running totals; down the rows, the best stretch
    ends where the running total exceeds its earlier minimum most. Among equal sums the first left,
    right and bottom win, and the earliest top. A grid, which is bounded, is looked at in one task; cells shuffle once.
    """
    kind = scores.schema["image_id"].dataType.simpleString()

    def find(cells: pd.DataFrame) -> pd.DataFrame:
        y, x = cells["y"].to_numpy(), cells["x"].to_numpy()
        grid = np.zeros((y.max() + 1, x.max() + 1))
        grid[y, x] = cells["v"].to_numpy()
        return pd.DataFrame([(cells["image_id"].iloc[0], *_best_rectangle(grid))], columns=["image_id", "l", "t", "r", "b", "gain"])

    cells = scores.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(column).cast("double").alias("v"))
    return cells.groupBy("image_id").applyInPandas(find, f"image_id {kind}, l int, t int, r int, b int, gain double")


def predictions(probabilities: DataFrame) -> DataFrame:
    """(image_id, pred_box, pred_conf): box as fractions of the photo from cell probabilities.

    The confidence is the share of likely cells inside the box times the share of likely cells that
    are inside.
    """
    sized = probabilities.join(raster.grid_sizes(probabilities), "image_id")
    smooth = raster.blur(sized.withColumn("score", F.col("p")), ["score"], 3)
    found = best_rectangles(smooth.withColumn("score", F.col("score") - 0.5))
    cells = sized.join(found, "image_id")
    inside = (F.col("x") >= F.col("l")) & (F.col("x") < F.col("r")) & (F.col("y") >= F.col("t")) & (F.col("y") < F.col("b"))
    high = F.col("p") > 0.5
    counted = cells.groupBy("image_id", "gw", "gh", "l", "t", "r", "b").agg(
        F.count_if(inside).alias("n_in"), F.count_if(inside & high).alias("high_in"), F.count_if(high).alias("high")
    )
    conf = F.col("high_in") / F.greatest(F.col("n_in"), F.lit(1)) * (
        1 - (F.col("high") - F.col("high_in")) / F.greatest(F.col("high"), F.lit(1))
    )
    relative = box(F.col("l") / F.col("gw"), F.col("t") / F.col("gh"), F.col("r") / F.col("gw"), F.col("b") / F.col("gh"))
    return counted.select("image_id", relative.alias("pred_box"), F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)).alias("pred_conf"))


def examples_signature(samples: DataFrame) -> DataFrame:
    """(n, signature): changes when an example (path, box_l … box_b, mtime in seconds) does.

    Each example is hashed and the hashes are summed, so no order and no list of all is needed.
    """
    text = F.concat_ws(
        "|", "path", F.concat_ws(",", *[F.format_string("%.4f", f"box_{s}") for s in "ltrb"]), F.col("mtime").cast("long").cast("string")
    )
    digest = F.md5(text)
    parts = [F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)")) for at in (1, 13)]
    summed = samples.agg(F.count("*").alias("n"), parts[0].alias("a"), parts[1].alias("b"))
    return summed.select(
        "n", F.md5(F.concat_ws(":", F.lit(str(MODEL_VERSION)), "n", F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string"))).alias("signature")
    )


def model_status(samples: DataFrame, saved: DataFrame) -> DataFrame:
    """(n, needed, trained, cv_iou): whether the saved model (signature, cv_iou) fits the examples."""
    now = examples_signature(samples)
    known = saved.select("signature", "cv_iou", F.lit(True).alias("_saved"))
    trained = F.coalesce(F.col("_saved") & (F.col("n") >= MIN_PHOTOS), F.lit(False))
    return now.join(known, "signature", "left").select(
        "n", F.lit(MIN_PHOTOS).alias("needed"), trained.alias("trained"), F.when(trained, F.col("cv_iou")).alias("cv_iou")
    )


def evaluate_folds(cells: DataFrame, samples: DataFrame, folds: int = 5) -> DataFrame | None:
    """(image_id, path, fold, iou): boxes found by models that never saw the photo.

    Sample i in path order is tested in fold i mod k; a fold with fewer than three training photos
    is left out; None below four photos. ``samples`` has image_id, path and box as fractions.
    """
    n = samples.count()
    if n < MIN_PHOTOS + 1:
        return None
    k = max(2, min(folds, n))
    numbered = row_numbers(samples, [], ["path", "image_id"], "_i").withColumn("fold", (F.col("_i") - 1) % k)
    numbered = write_down(numbered.drop("_i"), "folds")
    cells = write_down(cells.join(raster.grid_sizes(cells), "image_id"), "features")
    sizes = {row["fold"]: row["count"] for row in numbered.groupBy("fold").count().collect()}
    tested = []
    for fold in range(k):
        rest = n - sizes.get(fold, 0)
        if rest < MIN_PHOTOS:
            continue
        model = train(cell_labels(cells, numbered.filter(F.col("fold") != fold)), rest)
        held = numbered.filter(F.col("fold") == fold)
        found = predictions(cell_probabilities(model, cells.join(held.select("image_id"), "image_id", "left_semi")))
        tested.append(found.join(held, "image_id").select(
            "image_id", "path", "fold", iou(F.col("pred_box"), F.col("box")).alias("iou")
        ))
    out = tested[0]
    for part in tested[1:]:
        out = out.unionByName(part)
    return write_down(out, "evaluation")
