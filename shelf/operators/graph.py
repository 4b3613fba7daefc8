"""Connected components by alternating star operations (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelf.session import write_down


#: Nodes with more than 1 / HUBS of all edge ends, 2 x HUBS of them at most, are hubs.
HUBS = 10_000
HUB_DEGREE = 1000


def _with_least(edges: DataFrame, low: DataFrame, key: list[str], degree: int) -> DataFrame:
    """``edges`` joined with ``low`` (one row per node: m, degree). A hub's edges stay in their tasks and meet its row, which
    is broadcast; the rest is an ordinary join in which no node has very many edges."""
    hubs = F.broadcast(low.filter(F.col("degree") > degree))
    rest = edges.join(hubs.select(*key), key, "left_anti")
    return edges.join(hubs, key).unionByName(rest.join(low.filter(F.col("degree") <= degree), key)).drop("degree")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``…, node, component) for every node with an edge; the component is its smallest node.

    ``by`` columns keep many independent graphs apart in one run. Each round links the larger
    neighbours of a node to the smallest one (large star) and then the smaller ones (small star);
    the number of rounds grows with the logarithm of the graph, not with its diameter. The minimum
    per node is a partial aggregate and goes to a hub's edges by broadcast, so a node with very many
    edges does not gather them in one task. Each round is written down before the next reads it.
    """
    by = list(by)
    key = by + ["u"]
    e = write_down(
        edges.select(*by, F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u <> v")
        .distinct(),
        "edges",
    )
    while not _is_star_forest(e, by):
        both = e.unionByName(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        degree = max(HUB_DEGREE, 2 * e.count() // HUBS)
        low = both.groupBy(*key).agg(F.min("v").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("u", "m"))
        large = (
            _with_least(both, write_down(low, "least"), key, degree)
            .filter("v > u")
            .select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = write_down(large, "large")
        low = write_down(large.groupBy(*key).agg(F.min("v").alias("m"), F.count("*").alias("degree")), "least")
        small = (
            _with_least(large, low, key, degree)
            .filter("v <> m")
            .select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        )
        e = write_down(
            small.unionByName(low.select(*by, "u", F.col("m").alias("v"))).distinct(), "edges"
        )
    members = e.select(*by, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(*by, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _is_star_forest(e: DataFrame, by: list[str]) -> bool:
    """Every node points to one root, and no root points anywhere."""
    one, none = F.lit(1), F.lit(0)
    roles = e.select(*by, F.col("u").alias("node"), one.alias("points"), none.alias("root")).unionByName(
        e.select(*by, F.col("v").alias("node"), none.alias("points"), one.alias("root"))
    )
    wrong = roles.groupBy(*by, "node").agg(F.sum("points").alias("p"), F.max("root").alias("r")).filter(
        "p > 1 or (p > 0 and r > 0)"
    )
    return wrong.isEmpty()
