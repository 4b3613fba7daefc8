"""Similar images into numbered review folders."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from shelf.functions import paths as P
from shelf.operators.similar import similar_groups
from shelf.operators.slots import free_destinations


def next_group_number(listing: DataFrame, review_root: str) -> Column:
    """One more than the highest ``group_<n>`` folder directly below ``review_root``."""
    child = F.get(P.folders_below("full_path", review_root), 0)
    number = F.regexp_extract(child, r"^group_(\d+)$", 1).try_cast("long")
    inside = listing.filter(P.in_scope("full_path", review_root))
    return (F.coalesce(inside.agg(F.max(number)).scalar(), F.lit(0)) + 1)


def selected_ranges(text: str, maximum: int) -> list[tuple[int, int]] | None:
    """Closed ranges of group numbers that ``text`` names, in order, touching ones joined; None for every group.

    ``a`` and ``all`` are every group; else numbers and ranges stand between commas or white space."""
    if text.strip().lower() in ("a", "all"):
        return None
    named = []
    for word in text.replace(",", " ").split():
        low, dash, high = word.partition("-")
        bounds = (low, high if dash else low)
        if not all(b.isdecimal() for b in bounds):
            raise ValueError(word)
        named.append(tuple(map(int, bounds)))
        if not 0 < named[-1][0] <= named[-1][1] <= maximum:
            raise ValueError(word)
    if not named:
        raise ValueError("nothing selected")
    joined: list[tuple[int, int]] = []
    for low, high in sorted(named):
        if joined and low <= joined[-1][1] + 1:
            low, high = joined[-1][0], max(high, joined.pop()[1])
        joined.append((low, high))
    return joined


def select_groups(groups: DataFrame, text: str) -> DataFrame:
    """The groups that ``text`` names; a number beyond the last group is an error."""
    ranges = selected_ranges(text, groups.agg(F.max("group_no")).first()[0] or 0)
    if ranges is None:
        return groups
    return groups.filter(reduce(or_, [F.col("group_no").between(low, high) for low, high in ranges]))


def review_moves(groups: DataFrame, listing: DataFrame, review_root: str) -> DataFrame:
    """Destination of each group member in ``group_NN``, numbered after the folders already there."""
    number = F.col("group_no") + F.col("_next") - 1
    plan = (
        groups.withColumn("_next", next_group_number(listing, review_root))
        .withColumn("dest_dir", F.concat(F.lit(review_root + "/group_"), F.format_string("%02d", number.cast("long"))))
        .withColumn("filename", P.basename("full_path"))
        .withColumnRenamed("full_path", "source")
        .drop("_next")
    )
    return free_destinations(plan, listing, ["source"])


def similarity_report(images: DataFrame, listing: DataFrame, threshold: int, review_root: str) -> DataFrame:
    """One row per group: size, spread, first member and review folder."""
    moves = review_moves(similar_groups(images, threshold), listing, review_root)
    return moves.groupBy("group_no", "spread", "dest_dir").agg(
        F.count("*").alias("images"), F.min("source").alias("first")
    )
