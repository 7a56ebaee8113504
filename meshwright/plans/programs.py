"""Vertex programs: traversal, multi-source traversal, ranking, products, components and cores."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import bit_positions, damped, new_bits, reciprocal
from meshwright.operators.components import connected_components
from meshwright.operators.graph import Graph, degrees, max_degree_vertex

from .recovery import cut
from .superstep import hops, run, spread, superstep


def bfs(g: Graph, root: int, max_depth: int | None = None, metrics: list[dict] | None = None) -> DataFrame:
    """(v, level) of every vertex reached from ``root`` along out-edges. A root outside 0..n-1 reaches nothing.

    Several hops make a plan (see ``hops``). ``metrics``, if given, gets a row for each level: step, frontier, seconds.
    """
    edges = g.by_with_loops()
    state = cut(g.vertices.select("v", F.when(F.col("v") == root, 0).cast("int").alias("level")).repartition(g.parts, "v"))
    done, front = 0, 1
    while front and (max_depth is None or done < max_depth):
        began = time.perf_counter()
        n = hops(g.n, front)
        n = n if max_depth is None else min(n, max_depth - done)
        ball = spread(state.filter(F.col("level") == done), edges, n, lambda i: {"level": (F.col("level") + F.col("far"), F.min)})
        ball = ball.select(F.col("v").alias("_v"), F.col("level").alias("_l"))
        state = cut(state.join(ball, F.col("v") == F.col("_v"), "left").select("v", F.coalesce("level", "_l").cast("int").alias("level")))
        found = {r["level"]: r["count"] for r in state.filter(F.col("level") > done).groupBy("level").count().collect()}  # n rows at most
        seconds = (time.perf_counter() - began) / n
        if metrics is not None:
            metrics += [{"step": i, "frontier": found[i], "seconds": seconds} for i in range(done + 1, done + n + 1) if i in found]
        done += n
        front = found.get(done, 0)
    edges.unpersist()
    return state.filter("level is not null")


def level_counts(levels: DataFrame) -> DataFrame:
    """(level, frontier): vertices first reached at each level."""
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("frontier"))


def unreached(g: Graph, levels: DataFrame) -> DataFrame:
    return g.vertices.join(levels, "v", "left_anti")


def multi_source(g: Graph, sources: list[int]) -> DataFrame:
    """(v, seen, history): bit i of seen is set if sources[i] reaches v; history has (level, mask) of the bits new at each level.

    All sources share every scan. At most 63 at a time; sources outside 0..n-1 reach nothing.
    """
    if not 0 < len(set(sources)) == len(sources) < 64:
        raise ValueError("1 to 63 different sources")
    edges = g.by_with_loops()
    own = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col("v") == s, F.lit(1 << i)).otherwise(0).cast("long") for i, s in enumerate(sources)])
    entry = lambda level, mask: F.struct(F.lit(level).cast("int").alias("level"), mask.alias("mask"))
    state = g.vertices.select("v", own.alias("seen"), own.alias("front")).withColumn("history", F.filter(F.array(entry(0, F.col("seen"))), lambda h: h["mask"] != 0))
    state = cut(state.repartition(g.parts, "v"))
    done, front, none = 0, len(sources), F.lit(0).cast("long")
    while front:
        n = hops(g.n, front)

        # _mj: bits of the sources that j hops lead to a vertex from; a hop makes the next one and keeps those before
        def send(i: int) -> dict:
            here, far = [(f"_m{j}", F.when(F.col("far") == 0, F.col(f"_m{j}"))) for j in range(i)], F.when(F.col("far") == 1, F.col(f"_m{i - 1}"))
            return {c: (x, F.bit_or) for c, x in [*here, (f"_m{i}", far)]}

        start = state.filter("front <> 0").select("v", F.col("front").alias("_m0"))
        ball = spread(start, edges, n, send).withColumnRenamed("v", "_v")
        known, fresh = F.col("seen"), []
        both = state.join(ball, F.col("v") == F.col("_v"), "left")
        for j in range(1, n + 1):
            both = both.withColumn(f"_f{j}", F.coalesce(new_bits(F.col(f"_m{j}"), known), none))
            fresh.append(F.col(f"_f{j}"))
            known = known.bitwiseOR(fresh[-1])
        history = F.filter(F.array(*[entry(done + j, f) for j, f in enumerate(fresh, 1)]), lambda h: h["mask"] != 0)
        state = cut(both.select("v", known.alias("seen"), fresh[-1].alias("front"), F.concat("history", history).alias("history")))
        done += n
        front = state.filter("front <> 0").count()
    edges.unpersist()
    return state.select("v", "seen", "history")


def source_masks(reached: DataFrame) -> DataFrame:
    return reached.filter("seen <> 0").select("v", F.col("seen").alias("mask"))


def source_levels(reached: DataFrame, sources: list[int]) -> DataFrame:
    """(source, v, level) for every pair."""
    each = reached.select("v", F.explode("history").alias("h")).select("v", "h.level", F.explode(bit_positions(F.col("h.mask"), len(sources))).alias("_i"))
    return each.select(F.element_at(F.array(*[F.lit(s).cast("long") for s in sources]), F.col("_i") + 1).alias("source"), "v", "level")


def spmv(g: Graph, x: DataFrame) -> DataFrame:
    """(v, y): y[v] is the sum of x over the out-neighbours of v, for every vertex; ``x`` has (v, x), missing entries are 0."""
    sums = g.edges.join(x.select(F.col("v").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("v")).agg(F.sum("x").alias("y"))
    return g.vertices.join(sums, "v", "left").select("v", F.coalesce("y", F.lit(0)).alias("y"))


def pagerank(g: Graph, iterations: int, damping: float = 0.85) -> DataFrame:
    """(v, rank) after so many rounds of rank = damping * sum of neighbours' rank / out-degree + 1 - damping, pulled along out-edges.

    Starts from 1/n; not normalised, no redistribution: PageRank for symmetric graphs. 0 iterations give the start.
    """
    edges = g.by("dst")
    start = F.lit(1.0) / F.lit(max(g.n, 1))
    # the vertices' fixed part stands apart, so that a round names the last ranks once and rounds chain into one plan
    fixed = cut(degrees(g).select("v", reciprocal(F.col("degree")).alias("inv")).repartition(g.parts, "v"))
    state = fixed.withColumn("rank", start)
    for i in range(1, iterations + 1):
        share = state.select(F.col("v").alias("_v"), (F.col("rank") * F.col("inv")).alias("_c"))
        sums = share.join(edges, F.col("_v") == F.col("dst")).groupBy(F.col("src").alias("_to")).agg(F.sum("_c").alias("_s"))
        state = fixed.join(sums, F.col("v") == F.col("_to"), "left").select("v", "inv", damped(F.coalesce("_s", F.lit(0.0)), damping).alias("rank"))
        if i % 10 == 0 or i == iterations:
            state = cut(state)
    edges.unpersist()
    return state.select("v", "rank")


def components(g: Graph) -> DataFrame:
    """(v, component): the smallest id of each weak component, for vertices with an edge."""
    return connected_components(g.edges)


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def giant_by_bfs(g: Graph) -> DataFrame:
    """(v): what the vertex with most out-edges reaches; the giant component of a symmetric graph."""
    top = max_degree_vertex(g.edges).first()
    if top is None:
        return g.vertices
    return bfs(g, top["v"]).select("v")


def components_hybrid(g: Graph) -> DataFrame:
    """The same labels as ``components`` on symmetric graphs: traversal first, labels for what it doesn't reach."""
    giant = cut(giant_by_bfs(g))
    rest = g.edges.join(giant.withColumnRenamed("v", "src"), "src", "left_anti")
    label = giant.agg(F.min("v").alias("component"))
    return giant.crossJoin(F.broadcast(label)).select("v", "component").union(connected_components(rest))  # one row is broadcast


def kcore(g: Graph, k: int, metrics: list[dict] | None = None) -> DataFrame:
    """(v, degree, round): peels vertices of degree <= k, round by round; round is null for survivors, whose degree is what is left.

    Degrees count out-edges, repeated edges and loops; meant for symmetric graphs, where survivors are the (k+1)-core.
    """
    edges = g.by("src")
    state = degrees(g).withColumn("round", F.lit(None).cast("int")).repartition(g.parts, "v")

    def step(s: DataFrame, i: int) -> DataFrame:
        out = F.col("round").isNull() & (F.col("degree") <= k)
        s = s.withColumn("round", F.when(out, i).otherwise(F.col("round")).cast("int"))
        left = F.when(F.col("round").isNull(), F.col("degree") - F.coalesce("msg", F.lit(0))).otherwise(F.col("degree"))
        return superstep(s, edges, F.col("round") == i, F.lit(1), F.count, {"degree": left})

    out = run(state, step, lambda i: F.col("round").isNull() & (F.col("degree") <= k), metrics=metrics)
    edges.unpersist()
    return out.select("v", "degree", "round")
