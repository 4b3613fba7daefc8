"""How each photo is cropped: detection, taught examples, learned offsets and model, in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelf.functions import geometry as G
from shelf.functions import paths as P
from shelf.operators.numbering import first_per, row_numbers
from shelf.operators.quantiles import exact_medians
from shelf.operators.slots import free_destinations
from shelf.session import write_down

# Confidence limits, kinds of documents and texts shown to people.
CONF_OK = 0.70
CONF_MIN = 0.30
MODEL_OK = 0.60
SHAPE_TOLERANCE = 0.03
TYPES = ("income", "invoice", "receipt", "other")
WARNING_LABELS = {
    "low_confidence": "ثقة منخفضة — راجع القص",
    "small_document": "الورقة صغيرة في الصورة",
    "full_frame": "الورقة تملأ الصورة (لا حاجة للقص)",
    "touches_edge": "الورقة قريبة من حافة الصورة / قد تكون مقطوعة",
    "tilted": "الورقة مائلة",
    "weak_prior": "اعتمد على مثال معلَّم فقط (لم تُكشف الورقة)",
    "prior_disagree": "القص المعلَّم يخالف الكشف التلقائي",
    "nothing_found": "لم يُعثر على ورقة",
    "too_small": "الصورة صغيرة جداً",
}

SIDES = "ltrb"
# Photo sizes whose priors (under 200 bytes each) are broadcast, and parts of a size beyond that.
PRIOR_ROWS = 100_000
PRIOR_PARTS = 16


# -- taught examples -------------------------------------------------------------------------


def latest_examples(examples: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """The newest usable example of each photo; with a listing, of photos that still exist."""
    newest = first_per(examples.filter("low_quality = 0"), ["source_path"], [-F.col("id")])
    if listing is None:
        return newest
    return newest.join(listing.select(F.col("full_path").alias("source_path")), "source_path", "left_semi")


def taught_priors(examples: DataFrame, shapes: DataFrame) -> DataFrame:
    """(w, h, box, n, spread, strong, type) for each distinct photo size that examples exist for.

    Examples count when they have the same orientation and an aspect ratio within 3 %. They are
    summed per ratio first. A size then needs the sums over a stretch of ratios: ratios are cut into
    steps as wide as the tolerance, so the size's own step counts in full, of the step below the
    upper end and of the step above the lower end. Those ends are running sums inside a step, read
    off by sorting sizes and examples together; no size is paired with single examples.
    """
    usable = examples.filter("low_quality = 0")
    names = [f"{k}_{s}" for k in "sq" for s in SIDES]
    sums = [F.sum(f"box_{s}").alias(f"s_{s}") for s in SIDES] + [
        F.sum(F.col(f"box_{s}") * F.col(f"box_{s}")).alias(f"q_{s}") for s in SIDES
    ]

    def placed(w: str, h: str) -> list[Column]:
        ratio = F.log(F.col(w) / F.col(h))
        return [(F.col(w) >= F.col(h)).alias("wide"), ratio.alias("ratio"), F.floor(ratio / SHAPE_TOLERANCE).alias("step")]

    taught = usable.select("*", *placed("img_w", "img_h")).groupBy("wide", "step", "ratio", "type").agg(
        F.count("*").alias("n"), *sums
    )
    taught = write_down(taught, "taught")
    values = ["n", *names]
    steps = taught.groupBy("wide", "step", "type").agg(*[F.sum(c).alias(f"all_{c}") for c in values])
    sizes = shapes.select("w", "h").distinct().select("w", "h", *placed("w", "h"))
    # (which step, where in it, whether equal ratios come before): the part up to there is read off
    def part(name: str, shift: int, turn: int) -> Column:
        at = F.col("ratio") + shift * SHAPE_TOLERANCE
        return F.struct(
            F.lit(name).alias("part"), (F.col("step") + shift).alias("step"), at.alias("at"), F.lit(turn).alias("turn")
        )

    asked = sizes.select("w", "h", "wide", F.inline(F.array(
        part("own", 0, 1), part("below", -1, 1), part("above", 1, -1)
    ))).join(steps.select("wide", "step", "type"), ["wide", "step"])
    line = taught.select("wide", "step", "type", F.col("ratio").alias("at"), F.lit(0).alias("turn"), *values).unionByName(
        asked, allowMissingColumns=True
    )
    upto = Window.partitionBy("wide", "step", "type").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    read = line.withColumns({c: F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in values}).filter("part is not null")
    read = read.join(steps, ["wide", "step", "type"])
    share = lambda c: (
        F.when(F.col("part") == "own", F.col(f"all_{c}")).when(F.col("part") == "below", F.col(f"all_{c}") - F.col(c)).otherwise(F.col(c))
    )
    near = read.select("w", "h", "type", *[share(c).alias(c) for c in values]).filter("n > 0")
    per_type = near.groupBy("w", "h", "type").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    total = per_type.groupBy("w", "h").agg(
        F.sum("n").alias("n"),
        # most frequent kind, the first in the alphabet among equals
        F.min_by("type", F.struct((-F.col("n")).alias("n"), "type")).alias("type"),
        *[F.sum(c).alias(c) for c in names],
    )
    mean = {s: F.col(f"s_{s}") / F.col("n") for s in SIDES}
    deviation = [F.sqrt(F.greatest(F.lit(0.0), F.col(f"q_{s}") / F.col("n") - mean[s] * mean[s])) for s in SIDES]
    size = {"l": "w", "t": "h", "r": "w", "b": "h"}
    return (
        total.withColumn("spread", F.when(F.col("n") > 1, F.greatest(*deviation)).otherwise(1.0))
        .withColumn("box", G.box(*[F.rint(mean[s] * F.col(size[s])).cast("int") for s in SIDES]))
        .withColumn("strong", (F.col("n") >= 3) & (F.col("spread") < 0.012))
        .select("w", "h", "box", "n", "spread", "strong", "type")
    )


def learned_offsets(examples: DataFrame) -> dict[str, float] | None:
    """Per side, how far outside the detected sheet people draw the box, as a share of the short
    side: the median over confident detections, within -0.06 and 0.10. None below two of them."""
    side = F.least("img_w", "img_h")
    sized = examples.filter((F.col("low_quality") == 0) & (F.col("det_conf") >= CONF_OK)).select(
        ((F.col("det_l") - F.col("box_l")) * F.col("img_w") / side).alias("l"),
        ((F.col("det_t") - F.col("box_t")) * F.col("img_h") / side).alias("t"),
        ((F.col("box_r") - F.col("det_r")) * F.col("img_w") / side).alias("r"),
        ((F.col("box_b") - F.col("det_b")) * F.col("img_h") / side).alias("b"),
    )
    n, medians = exact_medians(sized, list(SIDES))
    if n < 2:
        return None
    return {s: min(max(v, -0.06), 0.10) for s, v in medians.items()}


def save_example(drawn: DataFrame) -> DataFrame:
    """Rows for the examples table from drawn boxes in pixels: image_id, source_path, img_w, img_h,
    type, l, t, r, b and the detection det_l … det_conf as fractions."""
    w, h = F.col("img_w"), F.col("img_h")
    l = F.greatest(F.lit(0), F.least(w - 1, F.rint("l").cast("int")))
    t = F.greatest(F.lit(0), F.least(h - 1, F.rint("t").cast("int")))
    r = F.greatest(l + 1, F.least(w, F.rint("r").cast("int")))
    b = F.greatest(t + 1, F.least(h, F.rint("b").cast("int")))
    kind = F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise("other")
    return drawn.select(
        "image_id", "source_path", "img_w", "img_h", kind.alias("type"),
        (l / w).alias("box_l"), (t / h).alias("box_t"), (r / w).alias("box_r"), (b / h).alias("box_b"),
        *[f"det_{s}" for s in SIDES], "det_conf",
    )


# -- the plan --------------------------------------------------------------------------------


def _with_prior(images: DataFrame, prior: DataFrame) -> DataFrame:
    """``images`` with the prior of their size. A few sizes hold most photos: up to PRIOR_ROWS sizes are broadcast,
    beyond that the photos of a size are split and each part meets a copy of the size's prior."""
    if prior.count() <= PRIOR_ROWS:
        return images.join(F.broadcast(prior), ["w", "h"], "left")
    part = F.pmod(F.xxhash64(*images.columns), F.lit(PRIOR_PARTS))
    copies = prior.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PRIOR_PARTS - 1)).cast("array<bigint>")))
    return images.withColumn("_part", part).join(copies, ["w", "h", "_part"], "left").drop("_part")


def plan_crops(
    images: DataFrame,
    priors: DataFrame,
    offsets: dict[str, float] | None,
    margin_pct: float = 1.0,
    deskew: bool = False,
    taught_type: str | None = None,
) -> DataFrame:
    """Add the plan of each photo: box, quad, deskewed, conf, method, type, warnings, reason.

    ``images`` has w, h, the detection (quad, det_conf, angle, warnings; quad null when nothing was
    found) and the model's prediction (pred_box as fractions, pred_conf; null without a model).
    """
    w, h = F.col("w"), F.col("h")
    side = F.least(w, h)
    found = F.col("quad").isNotNull()
    text = F.lit(None).cast("string")
    pred = F.col("pred_box")
    model_box = G.box(*[F.rint(pred[s] * (w if s in "lr" else h)).cast("int") for s in SIDES])
    prior = write_down(priors.select("w", "h", F.struct("box", "strong", "type").alias("_prior")), "priors")
    staged = (
        _with_prior(images, prior)
        .withColumn("_conf", F.coalesce("det_conf", F.lit(0.0)))
        .withColumn("_bounds", G.quad_bounds(F.col("quad"), w, h))
        .withColumn("_model_box", F.when(F.col("pred_conf").isNotNull(), model_box))
    )
    conf = F.col("_conf")
    strong = F.coalesce(F.col("_prior.strong"), F.lit(False))
    disagrees = strong & found & (conf >= 0.75) & (G.iou(F.col("_prior.box"), F.col("_bounds")) < 0.7)
    staged = (
        staged.withColumn("_disagrees", F.coalesce(disagrees, F.lit(False)))
        .withColumn(
            "_way",
            F.when(F.col("pred_conf").isNotNull() & ((F.col("pred_conf") >= MODEL_OK) | (conf < CONF_OK)), "learned")
            .when(strong & ~F.col("_disagrees"), "taught")
            .when(F.col("_prior").isNotNull() & ~strong & (~found | (conf < CONF_MIN)), "prior")
            .when(~found | (conf < CONF_MIN), "none")
            .otherwise("calibrated" if offsets else "auto"),
        )
        .withColumn(
            "_straighten",
            F.col("_way").isin("calibrated", "auto") & F.lit(deskew) & (F.abs("angle") >= 0.7)
            & ~F.array_contains("warnings", "full_frame"),
        )
    )
    way = F.col("_way")
    if offsets:
        margins = {s: F.lit(offsets[s]) * side for s in SIDES}
    else:
        margins = {s: F.lit(margin_pct / 100.0) * side for s in SIDES}
    bounds = F.col("_bounds")
    roomy = G.box(
        F.greatest(F.lit(0.0), bounds["l"] - margins["l"]).cast("int"),
        F.greatest(F.lit(0.0), bounds["t"] - margins["t"]).cast("int"),
        F.least(w.cast("double"), bounds["r"] + margins["r"]).cast("int"),
        F.least(h.cast("double"), bounds["b"] + margins["b"]).cast("int"),
    )
    fitted = G.fit_inside(F.col("quad"), w, h, G.box(*[margins[s] for s in SIDES]))
    staged = staged.withColumn("_fitted", F.when(F.col("_straighten"), fitted)).withColumn("_roomy", roomy)
    wide_enough = (F.col("_roomy.r") - F.col("_roomy.l") >= 8) & (F.col("_roomy.b") - F.col("_roomy.t") >= 8)
    staged = staged.withColumn(
        "box",
        F.when(way == "learned", F.col("_model_box"))
        .when(way.isin("taught", "prior"), F.col("_prior.box"))
        .when(F.col("_straighten"), G.quad_bounds(F.col("_fitted"), w, h))
        .when(way.isin("calibrated", "auto") & wide_enough, F.col("_roomy")),
    )
    edge = (F.col("box.l") <= 0) | (F.col("box.t") <= 0) | (F.col("box.r") >= w) | (F.col("box.b") >= h)
    none = F.array().cast("array<string>")

    def flag(condition: Column, name: str) -> Column:
        return F.when(condition, F.array(F.lit(name))).otherwise(none)

    without = lambda *names: F.filter("warnings", lambda x: ~x.isin(*names))
    warnings = (
        F.when(way == "learned", F.concat(flag(F.col("pred_conf") < CONF_OK, "low_confidence"), flag(edge, "touches_edge")))
        .when(way == "taught", without("low_confidence", "nothing_found"))
        .when(way == "prior", F.concat(without("nothing_found"), F.array(F.lit("weak_prior"))))
        .otherwise(F.concat("warnings", flag(F.col("_disagrees"), "prior_disagree")))
    )
    plan_quad = F.when(F.col("_straighten"), F.col("_fitted")).when(F.col("box").isNotNull(), G.box_quad(F.col("box")))
    reason = F.when(
        F.col("box").isNull(),
        F.when(~found, WARNING_LABELS["nothing_found"]).otherwise(WARNING_LABELS["low_confidence"]),
    )
    planned = (
        staged.withColumn("plan_quad", plan_quad)
        .withColumn("deskewed", F.col("_straighten"))
        .withColumn(
            "conf",
            F.when(way == "learned", F.col("pred_conf")).when(way == "taught", 0.9).when(way == "prior", 0.45).otherwise(conf),
        )
        .withColumn("method", way)
        .withColumn(
            "type",
            F.when(way == "learned", F.lit(taught_type)).when(way.isin("taught", "prior"), F.col("_prior.type")).otherwise(text),
        )
        .withColumn("plan_warnings", warnings)
        .withColumn("angle", F.when(way == "learned", 0.0).otherwise(F.coalesce("angle", F.lit(0.0))))
        .withColumn("reason", reason)
        .drop("_prior", "_conf", "_bounds", "_model_box", "_disagrees", "_way", "_straighten", "_fitted", "_roomy")
    )
    # the plan is read by several reports, each with its own filters: it is built once
    return write_down(planned, "crop-plan")


def plan_sizes(plans: DataFrame) -> DataFrame:
    """Add out_size, gain (percent of the photo removed) and needs_review."""
    warned = F.arrays_overlap("plan_warnings", F.array(F.lit("weak_prior"), F.lit("prior_disagree")))
    return (
        plans.withColumn("out_size", G.out_size(F.col("box"), F.col("plan_quad"), F.col("deskewed")))
        .withColumn("gain", G.gain_percent(F.col("out_size"), F.col("w"), F.col("h")))
        .withColumn("needs_review", (F.col("conf") < CONF_OK) | F.coalesce(warned, F.lit(False)))
    )


def crop_results(plans: DataFrame, min_gain: float = 5.0) -> DataFrame:
    """Add status (pending or skipped) and why a photo is skipped."""
    small = F.col("gain") < min_gain
    saved = F.format_string("لا حاجة للقص (يوفّر %.1f%% فقط)", F.bround("gain", 1))
    return plans.withColumn(
        "status", F.when(F.col("box").isNull() | small, "skipped").otherwise("pending")
    ).withColumn("skip_reason", F.when(F.col("box").isNull(), F.col("reason")).when(small, saved))


def crop_log(results: DataFrame, listing: DataFrame, root: str, out_root: str, run_id: str) -> DataFrame:
    """Operation-log rows of the pending crops: copies go below ``out_root`` under free names."""
    rel = P.relative_to("full_path", root)
    folder = F.concat_ws("/", F.lit(out_root), F.nullif(P.dirname(F.concat(F.lit("/"), rel)), F.lit("")))
    pending = results.filter("status = 'pending'").withColumn("dest_dir", F.replace(folder, F.lit("//"), F.lit("/")))
    placed = free_destinations(pending.withColumn("filename", P.basename("full_path")), listing, ["full_path"])
    return placed.select(
        F.lit(run_id).alias("run_id"), F.lit("crop").alias("op"), F.col("full_path").alias("source"),
        "destination", detail_json().alias("detail"), F.lit("pending").alias("status"),
    )


def result_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("images"), F.count_if("needs_review").alias("to_review"))


# -- detail text -----------------------------------------------------------------------------


def _rounded(quad: Column) -> Column:
    return F.transform(quad, lambda p: F.array(F.bround(p["x"], 1), F.bround(p["y"], 1)))


def detail_json() -> Column:
    """The plan as JSON text for the operation log; absent parts are written as null."""
    b = F.col("box")
    size = F.col("out_size")
    parts = F.struct(
        F.col("method").alias("method"),
        F.coalesce("type", F.lit("unknown")).alias("type"),
        F.bround("conf", 3).alias("conf"),
        F.col("plan_warnings").alias("warnings"),
        F.bround("angle", 2).alias("angle"),
        F.col("deskewed").alias("deskew"),
        F.array("w", "h").alias("src"),
        F.when(size.isNotNull(), F.array(size["w"], size["h"])).otherwise(F.array(F.lit(0), F.lit(0))).alias("out"),
        _rounded(F.col("plan_quad")).alias("quad"),
        _rounded(F.col("quad")).alias("detect_quad"),
        F.when(b.isNotNull(), F.array(*[b[s] for s in SIDES])).alias("box"),
    )
    return F.to_json(parts, {"ignoreNullFields": "false"})


DETAIL = (
    "method string, note string, type string, conf double, warnings array<string>, angle double, deskew boolean, "
    "src array<int>, out array<int>, quad array<array<double>>, detect_quad array<array<double>>, box array<int>"
)


def parse_detail(detail: Column | str) -> Column:
    """Struct from a log detail; plain text of old logs becomes method ``legacy`` with that note."""
    detail = P.as_column(detail)
    is_object = F.coalesce(F.ltrim(F.get_json_object(detail, "$")).startswith("{"), F.lit(False))
    legacy = F.to_json(F.struct(
        F.lit("legacy").alias("method"), F.coalesce(detail, F.lit("")).alias("note"),
        F.array().cast("array<string>").alias("warnings"),
    ))
    return F.from_json(F.when(is_object, detail).otherwise(legacy), DETAIL)


# -- reports ---------------------------------------------------------------------------------


def review_report(results: DataFrame) -> DataFrame:
    """Pending crops with ``position``: doubtful first, then the least confident; warnings as texts."""
    labels = F.create_map(*[F.lit(x) for pair in WARNING_LABELS.items() for x in pair])
    shown = results.filter("status = 'pending'").withColumn(
        "labels", F.transform("plan_warnings", lambda x: F.coalesce(F.try_element_at(labels, x), x))
    )
    return row_numbers(shown, [], [F.desc("needs_review"), F.col("conf"), F.col("image_id")], "position")


def box_or_reason(plans: DataFrame) -> DataFrame:
    """(image_id, box, method, type), or without a box (image_id, null, reason, null)."""
    cropped = F.col("box").isNotNull()
    return plans.select(
        "image_id", "box",
        F.when(cropped, F.col("method")).otherwise(F.coalesce("reason", F.lit("none"))).alias("method"),
        F.when(cropped, F.col("type")).alias("type"),
    )
