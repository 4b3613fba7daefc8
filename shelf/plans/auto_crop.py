"""From photos to the rows of the operation log: decode, detect, predict, plan, log.

Every stage works on the photos that the stage before it let through. Each photo has one row at the end, which says how far
it came: no photo's fault stops the others.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, functions as F

from shelf.operators import crop, locate
from shelf.operators.detect import detect_in_grids
from shelf.operators.fine import FINE_SIDE
from shelf.operators.numbering import first_per
from shelf.session import spread, write_down
from shelf.sources import images as I

# Cells along the long side of the grid that sheets are found on, and of the model's, whose cells are of 6 x 6.
FOUND_SIDE = 480
MODEL_SIDE, MODEL_CELL, MODEL_SMALLEST = 96, 6, 8


def detected(grids: DataFrame, tolerance: float = 28) -> DataFrame:
    """(full_path, w, h, quad, det_conf, angle, warnings) of written two-grid rows; quads in pixels of the upright photo."""
    fine = grids.select(F.col("full_path").alias("image_id"), *[F.col(f"fine_{c}").alias(c) for c in ("gw", "gh", "r", "g", "b")])
    coarse = grids.select(F.col("full_path").alias("image_id"), "gw", "gh", "r", "g", "b")
    found = detect_in_grids(coarse, tolerance, fine)
    scale = F.least(F.lit(1.0), F.lit(float(FINE_SIDE)) / F.greatest("w", "h"))
    quad = F.transform("quad", lambda p: F.struct((p["x"] / scale).alias("x"), (p["y"] / scale).alias("y")))
    sized = found.withColumnRenamed("image_id", "full_path").drop("gw", "gh").join(grids.select("full_path", "w", "h"), "full_path")
    return sized.select("full_path", "w", "h", F.when(F.col("quad").isNotNull(), quad).alias("quad"), F.col("conf").alias("det_conf"), "angle", "warnings")


def predicted(images: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """(full_path, pred_box, pred_conf) of a trained locator."""
    pixels = I.to_cells(I.to_grids(images, MODEL_SIDE, MODEL_SMALLEST, MODEL_CELL, grow=True)).withColumnRenamed("full_path", "image_id")
    cells = locate.cell_features(pixels, MODEL_CELL)
    return locate.predictions(locate.cell_probabilities(model, cells)).withColumnRenamed("image_id", "full_path")


def auto_crop(
    images: DataFrame,
    listing: DataFrame,
    root: str,
    out_root: str,
    run_id: str,
    examples: DataFrame | None = None,
    model: RandomForestClassificationModel | None = None,
    taught_type: str | None = None,
    margin_pct: float = 1.0,
    min_gain: float = 5.0,
    deskew: bool = False,
    tolerance: float = 28,
) -> DataFrame:
    """One row per photo of ``images`` (as read_images gives them; rows that repeat a path count once): full_path, w, h,
    status, stage, reason, box, method, conf, gain, needs_review, destination, detail, run_id.

    status is ``pending`` for a photo to crop, with the destination and detail of its log row; ``skipped`` where there is no
    sheet or nothing to gain; ``error`` where the photo could not be decoded. stage is the last one that looked at it, reason
    says why it went no further. ``examples`` are taught boxes, ``model`` a trained locator; both may be missing.
    """
    photos = first_per(images, ["full_path"], ["width", "height"])
    grids = write_down(I.two_grids(spread(photos, "full_path"), FOUND_SIDE, FINE_SIDE), "photo-grids")
    decoded = grids.filter("reason is null")
    found = write_down(detected(decoded, tolerance), "detected")
    if model is None:
        asked = found.withColumns({"pred_box": F.lit(None).cast("struct<l:double,t:double,r:double,b:double>"), "pred_conf": F.lit(None).cast("double")})
    else:
        usable = photos.join(decoded.select("full_path"), "full_path", "left_semi")
        asked = found.join(predicted(usable, model), "full_path", "left")
    asked = asked.withColumn("image_id", F.col("full_path"))
    priors = crop.taught_priors(examples, asked) if examples is not None else _no_priors(asked)
    offsets = crop.learned_offsets(examples) if examples is not None else None
    plans = crop.plan_sizes(crop.plan_crops(asked, priors, offsets, margin_pct, deskew, taught_type))
    results = write_down(crop.crop_results(plans, min_gain), "crop-results")
    log = crop.crop_log(results, listing, root, out_root, run_id).select(F.col("source").alias("full_path"), "destination", "detail")
    stage = F.when(F.col("status") == "pending", "log").when(F.col("box").isNull() & F.col("quad").isNull(), "detect").otherwise("plan")
    planned = results.join(log, "full_path", "left").select(
        "full_path", "w", "h", "status", stage.alias("stage"), F.col("skip_reason").alias("reason"), "box", "method", "conf", "gain", "needs_review", "destination", "detail"
    )
    kinds = {f.name: f.dataType for f in planned.schema}
    lost = {"full_path": F.col("full_path"), "status": F.lit("error"), "stage": F.lit("decode"), "reason": F.col("reason")}
    failed = grids.filter("reason is not null").select(*[lost.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in planned.columns])
    return planned.unionByName(failed).withColumn("run_id", F.lit(run_id))


def _no_priors(like: DataFrame) -> DataFrame:
    return like.select("w", "h", F.lit(None).cast("struct<l:int,t:int,r:int,b:int>").alias("box"), F.lit(False).alias("strong"), F.lit(None).cast("string").alias("type")).filter("false")


def log_rows(cropped: DataFrame) -> DataFrame:
    """Operation-log rows of the pending photos."""
    return cropped.filter("status = 'pending'").select(
        "run_id", F.lit("crop").alias("op"), F.col("full_path").alias("source"), "destination", "detail", F.lit("pending").alias("status")
    )
