"""Parameters learned from a stream of answers, kept in the stream's own state store.

Each profile has a state of two numbers; a batch is read once, and of the state only the profiles with new answers are
touched. Answers of a profile must arrive in id order across batches; inside a batch they are put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelf.operators.folds import BOUNDS, DEFAULTS, MARGIN_STEP

_STATE = "margin double, threshold int"


def learned(margin: float, threshold: int, kind: str | None, spread: int | None) -> tuple[float, int]:
    """Both parameters after one answer, as the effects of ``folds`` have it."""
    low, high = BOUNDS["crop_margin_pct"]
    least, most = BOUNDS["similarity_threshold"]
    if kind == "crop_too_tight":
        margin = min(max(margin + MARGIN_STEP, low), high)
    elif kind == "crop_too_loose":
        margin = min(max(margin - MARGIN_STEP, low), high)
    elif kind == "similar_yes" and (spread is None or spread >= threshold - 2):
        threshold = min(most, threshold + 1)
    elif kind == "similar_no":
        threshold = max(least, min(threshold - 1, max(least, least if spread is None else spread - 2)))
    elif kind == "reset":
        margin, threshold = DEFAULTS["crop_margin_pct"], DEFAULTS["similarity_threshold"]
    return margin, threshold


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    margin, threshold = state.get if state.exists else (DEFAULTS["crop_margin_pct"], DEFAULTS["similarity_threshold"])
    answers = pd.concat(list(batches)).sort_values(["id", "kind", "spread"])
    for kind, spread in zip(answers["kind"], answers["spread"]):
        margin, threshold = learned(margin, threshold, None if pd.isna(kind) else kind, None if pd.isna(spread) else int(spread))
    state.update((margin, threshold))
    yield pd.DataFrame({"profile": [key[0]], "last_id": [int(answers["id"].max())], "margin": [round(margin, 2)], "threshold": [threshold]})


def follow_online(feedback: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Append (profile, last_id, margin, threshold) for every profile with answers in a batch; the state store in
    ``checkpoint`` carries on from there after a restart."""
    kind = feedback.schema["profile"].dataType.simpleString()
    updates = feedback.select("profile", F.col("id").cast("long").alias("id"), "kind", "spread").groupBy("profile").applyInPandasWithState(
        _step, f"profile {kind}, last_id long, margin double, threshold int", _STATE, "append", GroupStateTimeout.NoTimeout
    )
    return (
        updates.writeStream.format("parquet").outputMode("append").option("path", out_path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_online(spark: SparkSession, out_path: str) -> DataFrame:
    """(profile, margin, threshold): each profile's latest row."""
    latest = F.max_by(F.struct("margin", "threshold"), "last_id").alias("p")
    return spark.read.parquet(out_path).groupBy("profile").agg(latest).select("profile", "p.margin", "p.threshold")
