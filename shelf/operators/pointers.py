"""Following pointers from row to row by doubling: logarithmic rounds, whatever the chain length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelf.session import write_down


def resolve(nodes: DataFrame) -> DataFrame:
    """(id, value) for nodes (id, next, value): a node without a value takes that of the node it
    points to. Chains must end in a node with a value; each id occurs once."""
    state = write_down(nodes.select("id", "next", "value"), "pointers")
    while not state.filter("value is null").isEmpty():
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("value").alias("_value"))
        open_ = state.filter("value is null").join(ahead, "next").select(
            "id", F.col("_next").alias("next"), F.col("_value").alias("value")
        )
        state = write_down(state.filter("value is not null").unionByName(open_), "pointers")
    return state.select("id", "value")


def reachable(nodes: DataFrame, head: int) -> DataFrame:
    """(id) of the nodes met when following ``next`` from ``head``; the end has no next."""
    spark = nodes.sparkSession
    jump = write_down(nodes.select("id", "next"), "jumps")
    met = spark.createDataFrame([(head,)], "id bigint")
    while True:
        found = met.join(jump.filter("next is not null"), "id").select(F.col("next").alias("id"))
        if found.isEmpty():
            return met
        met = write_down(met.unionByName(found).distinct(), "met")
        jump = write_down(
            jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("_next")), "next", "left")
            .select("id", F.col("_next").alias("next")),
            "jumps",
        )
