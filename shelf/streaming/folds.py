"""Parameters learned from a stream of answers.

Each batch is reduced to one function per profile, as in the batch fold, and applied to the stored
value; a profile with very many answers is reduced in blocks like any other. Answers of a profile
must arrive in id order across batches.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelf.operators.folds import DEFAULTS, combined, margin_effect, threshold_effect


def _version(path: str, batch_id: int) -> str:
    return os.path.join(path, f"version={batch_id}")


def _apply(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """The state (profile, margin, threshold) after a batch."""
    margin, threshold = margin_effect(), threshold_effect()
    effects = (
        combined(batch, ["profile"], margin).withColumnRenamed("effect", "_m")
        .join(combined(batch, ["profile"], threshold).withColumnRenamed("effect", "_t"), "profile")
    )
    start_m, start_t = F.lit(DEFAULTS["crop_margin_pct"]), F.lit(DEFAULTS["similarity_threshold"])
    if state is None:
        joined = effects.withColumn("margin", start_m).withColumn("threshold", start_t)
    else:
        joined = state.join(effects, "profile", "full_outer")
        joined = joined.withColumn("margin", F.coalesce("margin", start_m)).withColumn("threshold", F.coalesce("threshold", start_t))
    return joined.select(
        "profile",
        F.when(F.col("_m").isNull(), F.col("margin")).otherwise(margin.on(F.col("_m"), F.col("margin"))).alias("margin"),
        F.when(F.col("_t").isNull(), F.col("threshold")).otherwise(threshold.on(F.col("_t"), F.col("threshold"))).alias("threshold"),
    )


def follow_feedback(feedback: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Keep a versioned state table from a stream of (id, profile, kind, spread).

    Batch n reads version n-1 and writes version n, so a repeated batch gives the same version.
    """

    def learn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_state(spark, state_path, batch_id - 1) if batch_id > 0 else None
        _apply(batch, before).write.mode("overwrite").parquet(_version(state_path, batch_id))

    return (
        feedback.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_state(spark: SparkSession, state_path: str, version: int) -> DataFrame:
    return spark.read.parquet(_version(state_path, version))
