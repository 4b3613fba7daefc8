"""Ordered folds over long histories.

One answer changes a parameter by a small function; answers in a row are the composition of their
functions, and composition is associative. So a history is cut into blocks of consecutive ids, each
block is reduced to one function, blocks are reduced again, and no task ever sees more than a block.
Two kinds of functions occur: shifts with bounds (the crop margin) and tables over the few values a
whole-number parameter may take (the similarity threshold).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shelf.session import write_down

# Rows of one block: ids are unique, so a block of this many ids holds no more rows. Walking a block
# copies its earlier results, so small blocks and one more level are cheaper than large blocks.
BLOCK_IDS = 256

# Parameter defaults and the range feedback may move them in.
DEFAULTS = {
    "similarity_threshold": 10,
    "crop_margin_pct": 1.0,
    "crop_tolerance": 28,
    "crop_deskew": 0,
    "crop_min_gain": 5.0,
}
BOUNDS = {
    "similarity_threshold": (4, 20),
    "crop_margin_pct": (0.0, 8.0),
    "crop_deskew": (0, 1),
    "crop_tolerance": (5, 90),
    "crop_min_gain": (1.0, 30.0),
}
MARGIN_STEP = 0.5


@dataclass(frozen=True)
class Effect:
    """How one event acts on a parameter, and how such actions combine."""

    of_event: Column
    identity: Column
    then: Callable[[Column, Column], Column]
    on: Callable[[Column, Column], Column]


def _clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, low), high)


def margin_effect(kind: str = "kind") -> Effect:
    """Too tight widens the crop margin by half a percent, too loose narrows it, within bounds."""
    low, high = BOUNDS["crop_margin_pct"]

    def bounded_shift(by, lo, hi) -> Column:
        return F.struct(
            F.lit(by).cast("double").alias("by"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi")
        )

    k = F.col(kind)
    nothing = bounded_shift(0.0, -1e300, 1e300)
    start = DEFAULTS["crop_margin_pct"]
    event = (
        F.when(k == "crop_too_tight", bounded_shift(MARGIN_STEP, low, high))
        .when(k == "crop_too_loose", bounded_shift(-MARGIN_STEP, low, high))
        .when(k == "reset", bounded_shift(0.0, start, start))
        .otherwise(nothing)
    )
    return Effect(
        event,
        nothing,
        lambda f, g: F.struct(
            (f["by"] + g["by"]).alias("by"),
            _clamp(f["lo"] + g["by"], g["lo"], g["hi"]).alias("lo"),
            _clamp(f["hi"] + g["by"], g["lo"], g["hi"]).alias("hi"),
        ),
        lambda f, x: F.bround(_clamp(x + f["by"], f["lo"], f["hi"]), 2),
    )


def threshold_effect(kind: str = "kind", spread: str = "spread") -> Effect:
    """A confirmed group at the threshold raises it by one; a rejected group lowers it to just under
    that group's spread, and by one at least."""
    low, high = BOUNDS["similarity_threshold"]
    values = F.sequence(F.lit(low), F.lit(high))
    k, s = F.col(kind), F.col(spread).cast("int")
    confirmed = F.transform(values, lambda t: F.when(s < t - 2, t).otherwise(F.least(F.lit(high), t + 1)))
    rejected = F.transform(
        values, lambda t: F.greatest(F.lit(low), F.least(t - 1, F.greatest(F.lit(low), s - 2)))
    )
    start = F.transform(values, lambda t: F.lit(DEFAULTS["similarity_threshold"]))
    event = (
        F.when(k == "similar_yes", confirmed).when(k == "similar_no", rejected).when(k == "reset", start)
        .otherwise(values)
    )
    return Effect(
        event,
        values,
        lambda f, g: F.transform(f, lambda t: F.element_at(g, t - low + 1)),
        lambda f, x: F.element_at(f, x.cast("int") - low + 1),
    )


def _levels(events: DataFrame, by: list[str], order: str, effect: Effect) -> list[DataFrame]:
    """Blocks of each level with their members and their combined effect, finest first."""
    highest = events.agg(F.max(order)).first()[0] or 0
    rows = events.select(*by, F.col(order).cast("long").alias("at"), effect.of_event.alias("effect"))
    levels = []
    while True:
        rows = (
            rows.groupBy(*by, F.expr(f"(at - pmod(at, {BLOCK_IDS})) div {BLOCK_IDS}").alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("at", "effect"))).alias("members"))
            .withColumn("effect", F.aggregate("members", effect.identity, lambda f, m: effect.then(f, m["effect"])))
            .withColumnRenamed("block", "at")
        )
        rows = write_down(rows, "blocks")
        levels.append(rows)
        highest //= BLOCK_IDS
        if highest == 0:
            return levels


def fold(events: DataFrame, by: list[str], start: Column, effect: Effect, order: str = "id") -> DataFrame:
    """(``by``…, value): the parameter after all events, in ``order``."""
    top = _levels(events, by, order, effect)[-1]
    return top.select(*by, effect.on(F.col("effect"), start).alias("value"))


def combined(events: DataFrame, by: list[str], effect: Effect, order: str = "id") -> DataFrame:
    """(``by``…, effect): what all events together do, for use on a stored value later."""
    return _levels(events, by, order, effect)[-1].select(*by, "effect")


def running(events: DataFrame, by: list[str], start: Column, effect: Effect, order: str = "id") -> DataFrame:
    """(``by``…, ``order``, before, after) for every event: totals upwards, then starts downwards. Events with equal
    ``order`` each have a row; they follow each other in the order of their effects."""
    levels = _levels(events, by, order, effect)
    starts = levels[-1].select(*by, "at", start.alias("start"))
    for depth in range(len(levels) - 1, -1, -1):
        blocks = levels[depth].drop("effect").join(starts, by + ["at"])
        step = F.struct(F.lit(0).cast("long").alias("at"), F.col("start").alias("before"), F.col("start").alias("after"))

        def advance(done: Column, m: Column) -> Column:
            last = F.element_at(done, -1)["after"]
            return F.concat(
                done,
                F.array(F.struct(m["at"].alias("at"), last.alias("before"), effect.on(m["effect"], last).alias("after"))),
            )

        walked = blocks.select(*by, F.aggregate("members", F.array(step), advance).alias("w"))
        walked = walked.select(*by, F.explode(F.slice("w", F.lit(2), F.size("w") - 1)).alias("s"))
        if depth == 0:
            return walked.select(*by, F.col("s.at").alias(order), "s.before", "s.after")
        starts = walked.select(*by, "s.at", F.col("s.before").alias("start"))
