"""Mixing sources to target weights by temperature, as budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from shelf.llm.skew import join_groups, join_small
from shelf.session import write_down

SEED = "mix"
PROBES = 64
ROUNDS = 4
HEX_DIGITS = 4
REPETITION = 2.0
#: Rounds in which a block cut to a budget goes on behind a document that does not fit.
FILL = 8


def n_words(text: Column) -> Column:
    """Words of a text: runs of anything but white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_shares(sized: DataFrame) -> DataFrame:
    """(source, n_docs, tokens, share) of every source that has tokens."""
    totals = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens")).filter("tokens > 0")
    whole = totals.agg(F.sum("tokens")).first()[0] or 1
    return totals.withColumn("share", F.col("tokens") / F.lit(float(whole)))


def _measures(shares: DataFrame, low: float, high: float) -> list:
    """Entropy and spread of repetitions at ``PROBES`` + 1 exponents between ``low`` and ``high``."""
    alphas = F.transform(F.sequence(F.lit(0), F.lit(PROBES)), lambda i: F.lit(low) + i * F.lit((high - low) / PROBES))
    return (
        shares.select(F.explode(alphas).alias("alpha"), F.log("share").alias("l"))
        .select("alpha", "l", F.exp(F.col("alpha") * F.col("l")).alias("u"))
        .groupBy("alpha")
        .agg(
            F.sum("u").alias("z"), F.sum(F.col("u") * F.col("alpha") * F.col("l")).alias("ul"),
            F.max((F.col("alpha") - 1) * F.col("l")).alias("most"), F.min((F.col("alpha") - 1) * F.col("l")).alias("least"),
        )
        .select("alpha", (F.log("z") - F.col("ul") / F.col("z")).alias("entropy"), (F.col("most") - F.col("least")).alias("spread"))
        .orderBy("alpha")
        .collect()
    )


def temperature_exponent(shares: DataFrame, entropy: float | None = None, repetition: float | None = None) -> float:
    """The exponent in [0, 1] that token shares are raised to.

    ``entropy``: the largest exponent whose weights have at least this entropy, in nats (0 if none has).
    ``repetition``: the smallest exponent at which no source is repeated more than ``repetition`` times as often
    as any other. Both fall or rise steadily with the exponent, so it is bisected, ``PROBES`` ways a round; each
    round is one aggregate over the sources. Without sources 1.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either entropy or repetition")
    if repetition is not None and repetition < 1:
        raise ValueError("repetition must be at least 1")
    if shares.isEmpty():
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        rows = _measures(shares, low, high)
        if entropy is not None:
            good = [i for i, r in enumerate(rows) if r["entropy"] >= entropy - 1e-9]
            if not good:
                return 0.0
            at = good[-1]
            if at == len(rows) - 1:
                return rows[at]["alpha"]
            low, high = rows[at]["alpha"], rows[at + 1]["alpha"]
        else:
            at = next(i for i, r in enumerate(rows) if r["spread"] <= log(repetition) + 1e-9)
            if at == 0:
                return rows[0]["alpha"]
            low, high = rows[at - 1]["alpha"], rows[at]["alpha"]
    return low if entropy is not None else high


def source_budgets(shares: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """(source, n_docs, tokens, weight, budget): tokens to take from each source. Without ``budget`` it is the
    smallest total under which every source is read whole at least once, so no document is lost."""
    raised = shares.withColumn("u", F.exp(F.lit(alpha) * F.log("share")))
    z, scale = raised.agg(F.sum("u"), F.max(F.col("tokens") / F.col("u"))).first()
    z, scale = z or 1.0, scale or 0.0
    total = float(scale) * z if budget is None else float(budget)
    wanted = F.col("u") / F.lit(z) * F.lit(total)
    return raised.select("source", "n_docs", "tokens", (F.col("u") / F.lit(z)).alias("weight"), F.floor(wanted + F.lit(1e-6)).alias("budget"))


def place_in_block(doc_id: Column, block: Column, seed: str = SEED) -> Column:
    """Where a document stands in the permutation of a block; a null doc_id counts as ''."""
    return F.md5(F.concat_ws(":", F.lit(seed), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _last_places(places: DataFrame) -> DataFrame:
    """(source, last_place, used): how far the running total of tokens, in order of place, stays within ``rest`` (equal
    places count together). The total runs over ``16 ** HEX_DIGITS`` ranges of places first, then inside the one
    range that holds the cut, so no task sees a whole source. Sources that take nothing have no row."""
    totals = places.groupBy("source", "range").agg(F.sum("tokens").alias("t"), F.max("rest").alias("rest"), F.max("place").alias("place"))
    upto = F.sum("t").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, 0))
    totals = write_down(totals.withColumn("upto", upto).filter(F.col("upto") - F.col("t") <= F.col("rest")), "ranges")
    cut = totals.filter("upto > rest").select("source", "range", (F.col("upto") - F.col("t")).alias("before"))
    inside = places.join(cut, ["source", "range"]).groupBy("source", "range", "place", "rest", "before").agg(F.sum("tokens").alias("t"))
    running = F.col("before") + F.sum("t").over(W.partitionBy("source", "range").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    inside = inside.withColumn("upto", running).filter("upto <= rest")
    last = totals.filter("upto <= rest").select("source", "place", "upto").unionByName(inside.select("source", "place", "upto"))
    return last.groupBy("source").agg(F.max("place").alias("last_place"), F.max("upto").alias("used"))


def block_plan(sized: DataFrame, budgets: DataFrame, seed: str = SEED, fill: int = 0) -> DataFrame:
    """(source, whole, last_place, more): whole blocks of a source, and what is taken of the block cut to what is left.

    A source with budget b and t tokens gives b div t whole blocks and one block cut to b mod t tokens: the
    documents in permuted order whose running total stays within it. ``last_place`` is null where that is none. A long
    document may end it early; then up to ``fill`` further rounds go on behind it with the documents that still fit. ``more``
    has these rounds as (after, upto, most): places, and the most tokens of a document."""
    plan = write_down(budgets.select(
        "source", "n_docs", F.floor(F.col("budget") / F.col("tokens")).alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest")
    ), "plan")
    drawn = join_groups(sized, plan.filter("rest > 0"), "source", "n_docs", sized.count())
    places = write_down(drawn.select(
        "source", "rest", "tokens", place_in_block(F.col("doc_id"), F.col("whole") + 1, seed).alias("place")
    ).withColumn("range", F.substring("place", 1, HEX_DIGITS)), "places")
    last = write_down(_last_places(places), "last")
    n_sources = plan.count()
    state = plan.join(last, "source", "left").select(
        "source", "whole", "last_place", F.array().cast(_ROUNDS).alias("more"), F.coalesce("last_place", F.lit("")).alias("after"), (F.col("rest") - F.coalesce("used", F.lit(0))).alias("left")
    )
    for _ in range(fill):
        state = write_down(state, "filled")
        left = state.filter("left > 0").select("source", "after", "left")
        open_ = join_small(places.drop("rest"), left, "source", n_sources, "inner").filter("place > after and tokens <= left")
        open_ = write_down(open_.select("source", "tokens", "place", "range", F.col("left").alias("rest")), "open")
        if open_.isEmpty():
            break
        found = _last_places(open_)
        step = F.array(F.struct("after", F.col("upto"), F.col("left").alias("most")))
        state = state.join(found.select("source", F.col("last_place").alias("upto"), "used"), "source", "left").select(
            "source", "whole", "last_place", F.when(F.col("upto").isNull(), F.col("more")).otherwise(F.concat("more", step)).alias("more"),
            F.coalesce("upto", "after").alias("after"), F.when(F.col("upto").isNull(), F.lit(0)).otherwise(F.col("left") - F.col("used")).alias("left"),
        )
    return state.select("source", "whole", "last_place", "more")


_ROUNDS = "array<struct<after:string,upto:string,most:bigint>>"


def block_permutations(docs: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with (block, place), each row once for every block that takes it; sort a block by place for its
    order. Rows of sources outside the plan (no tokens at all) come once, in block 1. Only the plan, one row per
    source, is looked up; texts stay in their partition. Columns of ``docs`` travel as one, so they may have any names but
    block and place."""
    key = F.coalesce("source", F.lit("")).alias("_source")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")
    looked_up = join_small(docs.select("doc_id", "text", row, key), plan.withColumnRenamed("source", "_source"), "_source", plan.count())
    whole = F.coalesce("whole", F.lit(1)).cast("long")
    blocks = F.explode(F.sequence(F.lit(1).cast("long"), whole + 1))
    rows = looked_up.select("doc_id", "text", "row", whole.alias("whole"), "last_place", "more", blocks.alias("block"))
    rows = rows.withColumn("place", place_in_block(F.col("doc_id"), F.col("block"), seed))
    place, tokens = F.col("place"), n_words(F.col("text"))
    later = F.exists("more", lambda m: (place > m["after"]) & (place <= m["upto"]) & (tokens <= m["most"]))
    taken = (F.col("block") <= F.col("whole")) | F.coalesce(place <= F.col("last_place"), F.lit(False)) | F.coalesce((F.size("more") > 0) & later, F.lit(False))
    return rows.filter(taken).select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)], "block", "place")


def mixed(
    docs: DataFrame, entropy: float | None = None, repetition: float | None = REPETITION, budget: int | None = None, seed: str = SEED
) -> DataFrame:
    """``docs`` with (block, place), its sources mixed to temperature weights.

    Token shares are raised to the exponent that meets the target entropy (nats) or the repetition limit, and
    normalised; each source is then read as permuted blocks up to its part of ``budget``. Without a budget every
    source is read at least once and, with a repetition limit r, no source more than r times. Give ``entropy``
    with ``repetition=None`` to mix by entropy.

    A null source counts as ''. Null and empty texts have no tokens but follow their source; repeated rows stand
    at the same place and share their fate. Texts of any length count whole; one that does not fit a cut block is passed over
    where a budget is given, and the block goes on with those that do (FILL rounds). Other columns pass through, whatever
    their names; ``docs`` must not have block or place.
    """
    sized = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), n_words(F.col("text")).alias("tokens"))
    sized = write_down(sized, "sized")
    shares = write_down(source_shares(sized), "shares")
    alpha = temperature_exponent(shares, entropy, None if entropy is not None else repetition)
    plan = write_down(block_plan(sized, source_budgets(shares, alpha, budget), seed, FILL if budget is not None else 0), "mix-plan")
    return block_permutations(docs, plan, seed)
