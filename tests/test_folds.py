import random

import pytest
from pyspark.sql import functions as F

from shelf.operators import folds, logs, quantiles
from shelf.operators.pointers import reachable, resolve


def step_threshold(t, kind, spread):
    if kind == "similar_yes":
        return t if spread < t - 2 else min(20, t + 1)
    if kind == "similar_no":
        return max(4, min(t - 1, max(4, spread - 2)))
    return 10 if kind == "reset" else t


@pytest.mark.parametrize("block", [3, 256])
def test_running_like_one_by_one(spark, monkeypatch, block):
    monkeypatch.setattr(folds, "BLOCK_IDS", block)
    rng = random.Random(block)
    kinds = ["crop_too_tight", "crop_too_loose", "similar_yes", "similar_no", "crop_good", "reset"]
    rows = [(i, rng.choice("pq"), rng.choices(kinds, [5, 5, 5, 5, 2, 1])[0], rng.randrange(21)) for i in sorted(rng.sample(range(900), 200))]
    df = spark.createDataFrame(rows, "id bigint, profile string, kind string, spread int")
    margins, thresholds, state = {}, {}, {"p": (1.0, 10), "q": (1.0, 10)}
    for i, p, kind, spread in rows:
        m, t = state[p]
        m2 = min(8.0, m + 0.5) if kind == "crop_too_tight" else max(0.0, m - 0.5) if kind == "crop_too_loose" else 1.0 if kind == "reset" else m
        t2 = step_threshold(t, kind, spread)
        margins[i], thresholds[i] = (m, m2), (t, t2)
        state[p] = (m2, t2)
    got = {r.id: (r.before, r.after) for r in folds.running(df, ["profile"], F.lit(1.0), folds.margin_effect()).collect()}
    assert got == margins
    got = {r.id: (r.before, r.after) for r in folds.running(df, ["profile"], F.lit(10), folds.threshold_effect()).collect()}
    assert got == thresholds
    assert {r.profile: r.value for r in folds.fold(df, ["profile"], F.lit(10), folds.threshold_effect()).collect()} == {p: t for p, (_, t) in state.items()}


def test_parameters_keep_defaults_for_wrong_text(spark):
    profiles = spark.createDataFrame([(1,)], "profile int")
    state = spark.createDataFrame([(1, "similarity_threshold", "10.0"), (1, "crop_tolerance", " 30 "), (1, "crop_min_gain", "x")], "profile int, key string, value string")
    got = {r.key: (r.value, r.is_default) for r in logs.effective_parameters(profiles, state).collect()}
    assert got["similarity_threshold"] == (10.0, True) and got["crop_tolerance"] == (30.0, False) and got["crop_min_gain"] == (5.0, True)
    assert logs.forget(state).isEmpty()


def test_exact_median(spark):
    df = spark.range(5001).select((F.xxhash64("id") / 1e15).alias("v"), (F.col("id") % 3).cast("double").alias("w"))
    assert quantiles.exact_medians(df, ["v", "w"], rows=10) == quantiles.exact_medians(df, ["v", "w"])
    even = df.limit(4000)
    assert quantiles.exact_medians(even, ["v"], rows=10)[1]["v"] == pytest.approx(quantiles.exact_medians(even, ["v"])[1]["v"], rel=1e-12)


def test_medians_take_few_passes(spark):
    """Passes depend on neither the number of columns nor on how values are spread; NaN is the largest value, as in the built-in median."""
    v = F.xxhash64("id") / 1e15
    df = spark.range(3001).select(v.alias("a"), F.exp(v / 100).alias("b"), (-v).alias("c"), F.when(F.col("id") % 3 == 0, float("nan")).otherwise(v).alias("d"))
    spark.sparkContext.setJobGroup("medians", "medians")
    got = quantiles.exact_medians(df, list("abcd"), rows=100)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("medians"))
    spark.sparkContext.setJobGroup("", "")
    assert got == quantiles.exact_medians(df, list("abcd"))
    assert jobs <= 20


def test_pointers(spark):
    rows = [(i, i - 1, None) for i in range(1, 60)] + [(0, None, True), (100, None, False), (101, 100, None)]
    got = {r.id: r.value for r in resolve(spark.createDataFrame(rows, "id bigint, next bigint, value boolean")).collect()}
    assert got == {i: True for i in range(60)} | {100: False, 101: False}
    nodes = spark.createDataFrame([(i, i + 2 if i < 40 else None) for i in range(42)], "id bigint, next bigint")
    assert sorted(r.id for r in reachable(nodes, 3).collect()) == list(range(3, 42, 2))


def test_repeated_ids_keep_every_row(spark):
    df = spark.createDataFrame([(7, "p", "crop_too_tight", 0)] * 300 + [(2**53 + 1, "p", "reset", 0)], "id bigint, profile string, kind string, spread int")
    rows = folds.running(df, ["profile"], F.lit(1.0), folds.margin_effect()).collect()
    assert len(rows) == 301 and sorted(r.after for r in rows if r.id == 7)[-1] == 8.0
    assert [(r.before, r.after) for r in rows if r.id == 2**53 + 1] == [(8.0, 1.0)]
