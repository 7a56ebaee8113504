"""Connected components of an edge table, in a number of rounds that grows with the logarithm of its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.plans.recovery import written


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """The map ``first`` followed by ``second``, both (v, to) and total on each other's values."""
    return first.join(second.select(F.col("v").alias("to"), F.col("to").alias("_next")), "to").select("v", F.col("_next").alias("to"))


def _roots(hooks: DataFrame) -> DataFrame:
    """Follows (v, to) to its fixed points, by doubling."""
    while True:
        four = _then(two := _then(hooks, hooks), two)
        ahead = _then(four, four).withColumnRenamed("to", "_far")
        hooks = written(four.join(ahead, "v"), "roots")
        if not hooks.filter("_far <> to").limit(1).count():
            return hooks.select("v", "to")
        hooks = hooks.select("v", F.col("_far").alias("to"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(v, component): for every endpoint, the smallest id it is connected with, directions ignored.

    Each round hooks every vertex to its smallest neighbour if that is smaller, follows the hooks to their roots, and
    contracts the graph to the roots; at least half of the vertices with an edge left vanish. Aggregations combine
    before their shuffles, and joins on a hot root have a unique side, so AQE can split the other. Each round's tables
    are written to the shared folder. An edge with a null end is dropped; loops make their vertex a component; an
    empty table gives no rows.
    """
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).dropna()
    both = written(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.select(F.col("a").alias("v"), F.col("a").alias("component")).distinct()
    left = both.filter("a <> b")
    while left.limit(1).count():
        root = _roots(written(left.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("to")), "hooks"))
        from_a = root.select(F.col("v").alias("a"), F.col("to").alias("_a"))
        from_b = root.select(F.col("v").alias("b"), F.col("to").alias("_b"))
        moved = labels.join(root.select(F.col("v").alias("component"), "to"), "component", "left")
        labels = written(moved.select("v", F.coalesce("to", "component").alias("component")), "labels")
        joined = left.join(from_a, "a").join(from_b, "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        left = written(joined.distinct(), "links")
    return labels
