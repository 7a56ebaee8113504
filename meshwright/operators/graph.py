"""A graph: an edge table and the size of its dense vertex universe."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    """A directed multigraph (src, dst) over vertices 0..n-1; loops and repeated edges count. ``n`` defaults to the largest id plus one."""

    edges: DataFrame
    size: int | None = None

    @cached_property
    def n(self) -> int:
        return self.size if self.size is not None else (stats(self.edges).first()["vert_count"] or 0)

    @property
    def vertices(self) -> DataFrame:
        return self.edges.sparkSession.range(self.n).withColumnRenamed("id", "v")

    @property
    def parts(self) -> int:
        """Parts that edges and states are dealt into; a stated number, as only equal numbers join without a shuffle."""
        return int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def by(self, column: str) -> DataFrame:
        """Edges dealt by one end and kept, so that each superstep joins them without a shuffle; lost parts are recomputed."""
        return self.edges.select("src", "dst").repartition(self.parts, column).persist()


    def by_with_loops(self) -> DataFrame:
        """(src, dst, far) dealt by src and kept: every edge, far 1, and for each vertex a loop, far 0."""
        far = self.edges.select("src", "dst", F.lit(1).cast("byte").alias("far"))
        loops = self.vertices.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0).cast("byte").alias("far"))
        return far.union(loops).repartition(self.parts, "src").persist()


def stats(edges: DataFrame) -> DataFrame:
    """min_vert, max_vert, edge_count, vert_count (largest id + 1), in one row; nulls and 0 for an empty table."""
    row = edges.agg(F.min(F.least("src", "dst")).alias("min_vert"), F.max(F.greatest("src", "dst")).alias("max_vert"), F.count(F.lit(1)).alias("edge_count"))
    return row.withColumn("vert_count", F.coalesce(F.col("max_vert") + 1, F.lit(0)))


def degrees(g: Graph, end: str = "src") -> DataFrame:
    """(v, degree) of every vertex, 0 included; ``end`` src: out-degree, dst: in-degree."""
    d = g.edges.groupBy(F.col(end).alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    return g.vertices.join(d, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))


def max_degree_vertex(edges: DataFrame) -> DataFrame:
    """(v, degree): the vertex with most out-edges, the smallest id of those."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "v").limit(1)
