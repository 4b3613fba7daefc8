"""Feedback and operation logs: parameters, counts, latest run, review."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from shelf.operators.folds import BOUNDS, DEFAULTS, margin_effect, running, threshold_effect, fold

CONF_OK = 0.70  # fixed value: from here on a crop needs no look


def new_run_id() -> str:
    """12 hex digits; one per job, never one per row."""
    return uuid.uuid4().hex[:12]


# -- parameters ------------------------------------------------------------------------------


def effective_parameters(profiles: DataFrame, state: DataFrame, by: str = "profile") -> DataFrame:
    """(profile, key, value, is_default, low, high): learned text read with the type of the default;
    text that does not fit (``10.0`` for a whole number) leaves the default."""
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("key"), F.lit(float(v)).alias("default"), F.lit(isinstance(v, int)).alias("whole"),
            F.lit(float(BOUNDS[k][0])).alias("low"), F.lit(float(BOUNDS[k][1])).alias("high"),
        )
        for k, v in DEFAULTS.items()
    ])
    wanted = profiles.select(by).distinct().select(by, F.inline(rows))
    text = F.trim("text")
    number = F.when(F.col("whole") & ~F.rlike(text, F.lit(r"^[+-]?[0-9]+$")), F.lit(None)).otherwise(
        text.try_cast("double")
    )
    return (
        wanted.join(state.select(by, "key", F.col("value").alias("text")), [by, "key"], "left")
        .withColumn("value", F.coalesce(number, "default"))
        .select(by, "key", "value", (F.col("value") == F.col("default")).alias("is_default"), "low", "high")
    )


def parameter_changes(feedback: DataFrame, by: str = "profile") -> DataFrame:
    """The change log: one row for every answer that moved a parameter."""
    parts = []
    for key, effect in (("crop_margin_pct", margin_effect()), ("similarity_threshold", threshold_effect())):
        default = DEFAULTS[key]
        steps = running(feedback, [by], F.lit(default), effect).filter("before <> after")
        parts.append(steps.select(
            by, "id", F.lit(key).alias("key"),
            F.col("before").cast("double").alias("old_value"), F.col("after").cast("double").alias("new_value"),
        ))
    return parts[0].unionByName(parts[1])


def learned_state(feedback: DataFrame, by: str = "profile") -> DataFrame:
    """(profile, key, value): what the answers so far taught; defaults are not stored."""
    margin = fold(feedback, [by], F.lit(DEFAULTS["crop_margin_pct"]), margin_effect())
    threshold = fold(feedback, [by], F.lit(DEFAULTS["similarity_threshold"]), threshold_effect())
    named = margin.select(by, F.lit("crop_margin_pct").alias("key"), F.col("value").cast("string").alias("value"))
    return named.unionByName(
        threshold.select(by, F.lit("similarity_threshold").alias("key"), F.col("value").cast("string").alias("value"))
    )


def forget(state: DataFrame) -> DataFrame:
    """Reset: no learned values; the feedback log is not touched."""
    return state.filter(F.lit(False))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Notes per kind and, with kind null, in total."""
    return feedback.rollup("kind").agg(F.count("*").alias("notes"))


# -- operations ------------------------------------------------------------------------------


def latest_run(log: DataFrame) -> DataFrame:
    """Rows of the run that the highest id belongs to."""
    return log.filter(F.col("run_id") == log.agg(F.max_by("run_id", "id")).scalar())


def run_summary(run: DataFrame) -> DataFrame:
    return run.groupBy("run_id", "op").agg(F.count("*").alias("operations"))


def pending(log: DataFrame) -> DataFrame:
    return log.filter("status = 'pending'").orderBy("id")


def state_snapshot(images: DataFrame, examples: DataFrame, log: DataFrame) -> DataFrame:
    """One row of counts."""
    by_status = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "rejected")]
    return log.agg(*by_status).select(
        images.agg(F.count("*")).scalar().alias("images"),
        examples.agg(F.count("*")).scalar().alias("examples"),
        "pending", "approved", "rejected",
    )


def review_decisions(log: DataFrame, decisions: DataFrame, listing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Apply decisions (id, approve) to the log.

    Refusals are handled before approvals, so an id in both ends approved. Every decision on a crop
    leaves a feedback row; a refused crop loses its copy (``removed``: distinct destinations, with a
    ``listing`` only of copies that are still there).
    """
    per_id = decisions.groupBy("id").agg(
        F.max("approve").alias("_approve"),
        F.count_if(~F.col("approve")).alias("_refused"),
        F.count_if("approve").alias("_approved"),
    )
    joined = log.join(per_id, "id", "left")
    reviewed = joined.withColumn(
        "status",
        F.when(F.col("_approve"), "approved").when(~F.col("_approve"), "rejected").otherwise(F.col("status")),
    ).select(*log.columns)
    crops = joined.filter("op = 'crop' and _approve is not null")
    kinds = F.concat(
        F.array_repeat(F.lit("crop_rejected"), F.col("_refused").cast("int")),
        F.array_repeat(F.lit("crop_approved"), F.col("_approved").cast("int")),
    )
    feedback = crops.select("id", F.explode(kinds).alias("kind"))
    removed = crops.filter("_refused > 0 and destination is not null").select("destination").distinct()
    if listing is not None:
        removed = removed.join(listing.select(F.col("full_path").alias("destination")), "destination", "left_semi")
    return {"log": reviewed, "feedback": feedback, "removed": removed}


def needs_review(conf: Column | str, warnings: Column | str) -> Column:
    """Low confidence or a doubtful example; a row without confidence needs no look."""
    conf = F.col(conf) if isinstance(conf, str) else conf
    warned = F.arrays_overlap(warnings, F.array(F.lit("weak_prior"), F.lit("prior_disagree")))
    return conf.isNotNull() & ((conf < CONF_OK) | F.coalesce(warned, F.lit(False)))


def example_summary(examples: DataFrame) -> DataFrame:
    return examples.groupBy("type", "img_w", "img_h").agg(F.count("*").alias("examples")).orderBy(F.desc("examples"))
