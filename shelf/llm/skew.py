"""Joins of rows with one row per group where a few groups may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_GROUPS = 10_000
SMALL_ROWS = 100_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``groups`` (unique, not null ``key``; ``size`` = rows of the group).

    Groups larger than 1 / HOT_GROUPS of ``n_rows``, at most HOT_GROUPS of them, are broadcast, so their rows
    stay where they are. The rest is an ordinary join in which no key is hot."""
    hot_size = max(1000, n_rows // HOT_GROUPS)
    hot = F.broadcast(groups.filter(F.col(size) > hot_size))
    there = rows.join(hot, key)
    rest = rows.join(hot.select(key), key, "left_anti")
    return there.unionByName(rest.join(groups.filter(F.col(size) <= hot_size), key, how))


def join_small(rows: DataFrame, table: DataFrame, key: str, n_table: int, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table`` of ``n_table`` counted rows: broadcast up to SMALL_ROWS, else shuffled."""
    return rows.join(F.broadcast(table) if n_table <= SMALL_ROWS else table, key, how)


SLOTS = 1 << 20


def perhaps_in(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``ids``, dropped before anything shuffles. The
    broadcast table holds the hash slots of the ids, at most SLOTS of them; an exact join must follow."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("_slot")
    slots = F.broadcast(ids.select(slot).distinct())
    return rows.withColumn("_slot", slot).join(slots, "_slot", "left_semi").drop("_slot")


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``dropped`` (a written table); rows with a null key stay. Rows whose hash slot
    no dropped key has stay in their partition, only the others shuffle."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("_slot")
    gone = dropped.select(key).filter(F.col(key).isNotNull()).distinct()
    slots = F.broadcast(gone.select(slot).distinct().withColumn("_there", F.lit(True)))
    marked = rows.withColumn("_slot", slot).join(slots, "_slot", "left")
    sure = marked.filter("_there is null")
    perhaps = marked.filter("_there").join(gone, key, "left_anti")
    return sure.unionByName(perhaps).select(*[F.col(f"`{c}`") for c in rows.columns])
