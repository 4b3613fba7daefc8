"""The file index and the hash cache as tables that are refreshed, not rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelf.operators.numbering import first_per, row_numbers


def insert_if_absent(index: DataFrame, scanned: DataFrame, order: str = "id") -> DataFrame:
    """Rows of ``scanned`` whose full_path the index lacks, one per path (the first by ``order``)."""
    once = first_per(scanned, ["full_path"], [order])
    return once.join(index.select("full_path"), "full_path", "left_anti").select(*scanned.columns)


def with_new_ids(index: DataFrame, added: DataFrame, order: str = "full_path") -> DataFrame:
    """Number added rows after the highest id of the index."""
    highest = index.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = row_numbers(added.drop("id"), [], [order], "_n")
    return numbered.withColumn("id", F.col("_n") + F.lit(highest)).drop("_n").select(*added.columns)


def refresh_hashes(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Compare files (full_path, mtime in seconds) with cached hashes by path and time.

    ``status``: reuse (cached, same time), compute (new or changed), stale (cached, file gone).
    """
    joined = files.select("full_path", F.col("mtime").alias("file_mtime")).join(
        cache.select("full_path", F.col("mtime").alias("cached_mtime")), "full_path", "full_outer"
    )
    status = (
        F.when(F.col("file_mtime").isNull(), "stale")
        .when(F.abs(F.col("file_mtime") - F.col("cached_mtime")) < 1e-6, "reuse")
        .otherwise("compute")
    )
    return joined.withColumn("status", status)


def refreshed_cache(cache: DataFrame, statuses: DataFrame, computed: DataFrame) -> DataFrame:
    """The cache after a refresh: computed rows replace old ones; rows of files that are gone are
    dropped, but only when at least one row was computed."""
    wrote = computed.agg(F.count("*") > 0).scalar()
    gone = statuses.filter(F.col("status") == "stale").select("full_path", F.lit(True).alias("gone"))
    kept = (
        cache.join(computed.select("full_path"), "full_path", "left_anti")
        .join(gone, "full_path", "left")
        .filter(~(F.coalesce("gone", F.lit(False)) & wrote))
        .drop("gone")
    )
    return kept.unionByName(computed.select(*cache.columns))


def apply_moves(index: DataFrame, moves: DataFrame) -> DataFrame:
    """The index after files moved from ``source`` to ``destination``."""
    moved = moves.select(F.col("source").alias("full_path"), "destination")
    return (
        index.join(moved, "full_path", "left")
        .withColumn("full_path", F.coalesce("destination", "full_path"))
        .drop("destination")
    )


def paths_there(listing: DataFrame, rows: DataFrame, column: str, flag: str) -> DataFrame:
    """(``column``, ``flag`` = true) of the paths in ``rows[column]`` that ``listing`` has. The listing is cut to the wanted paths
    before its repeats go, so only these move."""
    wanted = rows.select(F.col(column).alias("full_path")).filter("full_path is not null").distinct()
    found = listing.select("full_path").join(wanted, "full_path", "left_semi").distinct()
    return found.select(F.col("full_path").alias(column), F.lit(True).alias(flag))
