"""Row positions that stay cheap when one group holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelf.session import write_down

# A task may hold at most this many rows of one group; larger groups take the split path.
GROUP_ROWS = 1_000_000
# A numbering of the whole table has a single group; beyond this it pays to sort in parallel.
TABLE_ROWS = 50_000
HOT_GROUPS = 10_000


def largest_group(df: DataFrame, by: list[str]) -> int:
    counted = df.groupBy(*by).count() if by else df.agg(F.count("*").alias("count"))
    return counted.agg(F.max("count")).first()[0] or 0


def row_numbers(
    df: DataFrame,
    by: list[str],
    order: list[str | Column],
    name: str,
    group_rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Add ``name``: the 1-based position of a row among the rows with equal ``by`` columns.

    ``order`` must be a total order inside a group. Groups are counted first (a partial
    aggregation); as long as every group fits a task a plain window does the work. Otherwise all
    rows are range-partitioned by group and order, which spreads a hot group over many tasks, and
    the position is the distance from the group's first row in that global order. A caller that
    knows the size of the ``largest`` group saves the count.
    """
    if group_rows is None:
        group_rows = GROUP_ROWS if by else TABLE_ROWS
    largest = largest_group(df, by) if largest is None else largest
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    if largest <= group_rows:
        window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        return df.withColumn(name, F.row_number().over(window.orderBy(*order)))
    placed = global_position(df, [F.col(c) for c in by] + order, "_position")
    if not by:
        return placed.withColumnRenamed("_position", name)
    first = write_down(
        placed.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.min("_position").alias("_first"), F.count("*").alias("_rows")),
        "groups",
    )
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    # at most HOT_GROUPS groups are that large: they are sent to their rows, which stay where they are
    hot_rows = max(group_rows, (first.agg(F.sum("_rows")).first()[0] or 0) // HOT_GROUPS)
    hot = F.broadcast(first.filter(F.col("_rows") > hot_rows))
    rest = placed.join(hot, same, "left_anti").join(first.filter(F.col("_rows") <= hot_rows), same)
    joined = placed.join(hot, same).unionByName(rest).drop("_rows")
    return joined.withColumn(name, F.col("_position") - F.col("_first") + 1).drop(
        "_position", "_first", *[f"_by_{c}" for c in by]
    )


def global_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the 1-based position of a row in the order of the whole table.

    Rows are range-partitioned and sorted once and written down with their place inside the
    partition; only the row counts of the partitions (one row each) are summed and sent to all.
    """
    spark = df.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    placed = write_down(placed, "ordered")
    part = F.shiftright("_slot", 33)
    counts = placed.groupBy(part.alias("_part")).count()
    # at most n rows: one per range partition
    before = counts.select(
        "_part",
        F.coalesce(
            F.sum("count").over(
                Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_part", "_slot", "_before")
    )


def first_per(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The row of each group that comes first in ``order``.

    An aggregate rather than a window: the map side already keeps one row per group, so a group
    with very many copies costs no more shuffle than any other.
    """
    key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*by).agg(F.min_by(row, key).alias("_row")).select("_row.*")
