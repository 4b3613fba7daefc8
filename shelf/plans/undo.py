"""Plans that take a run back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelf.functions import paths as P
from shelf.operators.index import paths_there
from shelf.operators.logs import latest_run
from shelf.operators.slots import free_destinations
from shelf.session import write_down


def _restore(rows: DataFrame, listing: DataFrame, turn: str) -> DataFrame:
    """``action`` and ``target`` for log rows that are taken back in the order of ``turn``.

    The first row of a destination gets the file; later ones find it gone. A moved file returns to
    its source, or to the next free name when that is taken; a source that an earlier row of the
    plan has vacated counts as free.
    """
    exists = paths_there(listing, rows, "destination", "_there")
    takes = rows.groupBy("destination").agg(F.min(turn).alias("_first_take"))
    rows = (
        rows.join(takes, "destination")
        .join(exists, "destination", "left")
        .withColumn(
            "action",
            F.when(F.col("_there").isNull() | (F.col(turn) > F.col("_first_take")), "gone")
            .when(F.col("op") == "crop", "delete").otherwise("restore"),
        )
        .drop("_there", "_first_take")
    )
    rows = write_down(rows, "undo")
    moves = rows.filter("action = 'restore'")
    first_put = moves.groupBy(F.col("source").alias("full_path")).agg(F.min(turn).alias("_put"))
    vacated = (
        rows.filter("action <> 'gone'").select(F.col("destination").alias("full_path"), F.col(turn).alias("_take"))
        .join(first_put, "full_path").filter("_take < _put").select("full_path")
    )
    still = listing.join(vacated, "full_path", "left_anti")
    placed = free_destinations(
        moves.withColumn("dest_dir", P.dirname("source")).withColumn("filename", P.basename("source")),
        still, [turn], name="target",
    ).drop("dest_dir", "filename")
    return placed.unionByName(
        rows.filter("action <> 'restore'").withColumn("target", F.lit(None).cast("string"))
    )


def undo_latest(log: DataFrame, listing: DataFrame) -> DataFrame:
    """Take back the latest run, in log order: moved files return, cropped copies go."""
    return _restore(latest_run(log).filter("op in ('move', 'crop')"), listing, "id")


def undo_batch(log: DataFrame, listing: DataFrame, run_id: str | None = None) -> DataFrame:
    """Take back the renames of one run (by default the latest), newest first."""
    run = latest_run(log) if run_id is None else log.filter(F.col("run_id") == run_id)
    rows = run.filter("op = 'move'").withColumn("turn", -F.col("id"))
    return _restore(rows, listing, "turn")


def log_after(log: DataFrame, undone: DataFrame) -> DataFrame:
    """The log without the rows that were taken back; rows whose file is gone leave it too."""
    return log.join(undone.select("id"), "id", "left_anti")


def undo_counts(undone: DataFrame) -> DataFrame:
    return undone.groupBy("action").agg(F.count("*").alias("operations"))
