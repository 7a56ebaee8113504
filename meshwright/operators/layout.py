"""Graph layouts: offsets, adjacency, balanced two-dimensional partitions and block diagnostics.

Prefix sums over all vertices take two levels: sums per id range, a window over
those few sums, and a window inside each range, so no task sees all vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Graph, degrees

#: Vertices to a range of the two-level prefix sum.
RANGE = 1 << 16
#: Neighbour ids in a block.
BLOCK = 128
#: Steps that all ids are cut into, by which an id finds the range that it lies in.
STEPS = 1 << 10


def prefix_sum(df: DataFrame, value: str, within: tuple[str, ...] = (), key: str = "v", into: str = "cum", width: int = RANGE) -> DataFrame:
    """``df`` plus the inclusive sum of ``value`` in the order of ``key``, separately ``within``."""
    df = df.withColumn("_range", F.floor(F.col(key) / width))
    sums = df.groupBy(*within, "_range").agg(F.sum(value).alias("_sum"))
    across = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*within, "_range", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*within, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(into, F.sum(value).over(inside)).join(before, [*within, "_range"]).withColumn(into, F.col(into) + F.col("_before")).drop("_range", "_before")


def beg_pos(g: Graph) -> DataFrame:
    """(v, beg, end): where each vertex's neighbours lie in the adjacency array."""
    return prefix_sum(degrees(g), "degree").select("v", (F.col("cum") - F.col("degree")).alias("beg"), F.col("cum").alias("end"))


def csr_slots(g: Graph) -> DataFrame:
    """(v, slot, dst): every edge's place in the adjacency array, neighbours ascending.

    Places within a vertex come from a two-level sum over ranges of neighbours, so no task sees all edges of a hub.
    """
    pairs = g.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    placed = prefix_sum(pairs, "k", ("src",), "dst").join(beg_pos(g), F.col("src") == F.col("v"))
    last = F.col("beg") + F.col("cum") - 1
    return placed.select("v", F.explode(F.sequence(last - F.col("k") + 1, last)).alias("slot"), "dst")


def adjacency(g: Graph) -> DataFrame:
    """(v, neighbours): sorted neighbour lists of vertices with any."""
    return g.edges.groupBy(F.col("src").alias("v")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def adjacency_chunks(g: Graph, most: int = RANGE) -> DataFrame:
    """(v, chunk, neighbours): the same lists in chunks of at most ``most`` neighbours, so that no row holds all of a hub's."""
    pairs = g.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    placed = prefix_sum(pairs, "k", ("src",), "dst")
    places = placed.select(F.col("src").alias("v"), "dst", F.explode(F.sequence(F.col("cum") - F.col("k"), F.col("cum") - 1)).alias("place"))
    return places.groupBy("v", F.floor(F.col("place") / most).alias("chunk")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def _bounds(k_table: DataFrame, cuts: DataFrame, parts: int, n: int, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """From cuts (k, cut) of k = 1..parts-1: begin and end of each range; a cut that is never reached lies at n."""
    full = k_table.join(cuts, [*within, "k"], "left").withColumn("cut", F.when(F.col("k") == 0, 0).otherwise(F.coalesce("cut", F.lit(n))))
    after = F.lead("cut").over(Window.partitionBy(*within).orderBy("k"))
    return full.select(*within, F.col("k").cast("long").alias(name), F.col("cut").alias(f"{name}_beg"), F.coalesce(after, F.lit(n)).alias(f"{name}_end"))


def _cuts(cum: DataFrame, step: int, parts: int, value: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(k, cut): one below the first vertex from 1 on at which the sum reaches k * step."""
    first = F.floor((F.col("cum") - F.col(value)) / step) + 1
    last = F.least(F.floor(F.col("cum") / step), F.lit(parts - 1))
    ks = cum.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    return ks.groupBy(*within, "k").agg((F.min(F.greatest("v", F.lit(1))) - 1).alias("cut"))


def partition_p2d(g: Graph, rows: int, cols: int) -> DataFrame:
    """Equi-width ranges: (row, col, row_beg, row_end, col_beg, col_end); the last range takes the rest."""
    spark, n = g.edges.sparkSession, g.n
    grid = spark.range(rows).withColumnRenamed("id", "row").crossJoin(spark.range(cols).withColumnRenamed("id", "col"))  # rows * cols, parameters both

    def ends(name: str, parts: int) -> list[Column]:
        step = n // parts
        return [(F.col(name) * step).alias(f"{name}_beg"), F.when(F.col(name) == parts - 1, n).otherwise((F.col(name) + 1) * step).cast("long").alias(f"{name}_end")]

    return grid.select("row", "col", *ends("row", rows), *ends("col", cols))


def _equi_depth(g: Graph, end: str, parts: int, name: str) -> DataFrame:
    total = g.edges.count()
    step = max(total - 1, 0) // parts + 1
    deg = g.edges.groupBy(F.col(end).alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    ks = g.edges.sparkSession.range(parts).withColumnRenamed("id", "k")
    return _bounds(ks, _cuts(prefix_sum(deg, "degree"), step, parts, "degree"), parts, g.n, name)


def partition_independent(g: Graph, rows: int, cols: int) -> DataFrame:
    """Equi-depth rows by out-degree and, independently, columns by in-degree."""
    return _equi_depth(g, "src", rows, "row").crossJoin(_equi_depth(g, "dst", cols, "col")).select("row", "col", "row_beg", "row_end", "col_beg", "col_end")


def _located(edges: DataFrame, end: str, ranges: DataFrame, name: str, n: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Edges joined with the range that one of their ends lies in, by equal steps.

    Tables of ranges have as many rows as the parameters say, STEPS more a strip, and are broadcast.
    """
    width = -(-max(n, 1) // STEPS)
    low, high = F.col(f"{name}_beg"), F.col(f"{name}_end")
    steps = ranges.filter(low < high).withColumn("_step", F.explode(F.sequence(F.floor(low / width), F.floor((high - 1) / width))))
    met = edges.withColumn("_step", F.floor(F.col(end) / width)).join(F.broadcast(steps), ["_step", *on])
    return met.filter((F.col(end) >= low) & (F.col(end) < high))


def assign_rows(g: Graph, row_ranges: DataFrame) -> DataFrame:
    """Edges with the row strip of their source."""
    return _located(g.edges.select("src", "dst"), "src", row_ranges.select("row", "row_beg", "row_end").distinct(), "row", g.n).select("src", "dst", "row")


def partition_ultra(g: Graph, rows: int, cols: int) -> DataFrame:
    """Equi-depth rows by out-degree, then in each row equi-depth columns by the in-degree of that row's edges."""
    spark, n = g.edges.sparkSession, g.n
    row_ranges = _equi_depth(g, "src", rows, "row")
    total = g.edges.count()
    step = max(total - 1, 0) // (rows * cols) + 1
    deg = assign_rows(g, row_ranges).groupBy("row", F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    ks = row_ranges.select("row").crossJoin(spark.range(cols).withColumnRenamed("id", "k"))
    col_ranges = _bounds(ks, _cuts(prefix_sum(deg, "degree", ("row",)), step, cols, "degree", ("row",)), cols, n, "col", ("row",))
    return row_ranges.join(col_ranges, "row").select("row", "col", "row_beg", "row_end", "col_beg", "col_end")


def assign(g: Graph, ranges: DataFrame) -> DataFrame:
    """Edges with their (row, col) partition."""
    strips = assign_rows(g, ranges)
    return _located(strips, "dst", ranges.select("row", "col", "col_beg", "col_end"), "col", g.n, ("row",)).select("src", "dst", "row", "col")


def partition_edge_counts(g: Graph, ranges: DataFrame) -> DataFrame:
    """(row, col, edges) of the partitions that hold any."""
    return assign(g, ranges).groupBy("row", "col").agg(F.count(F.lit(1)).alias("edges"))


def partition_beg_pos(g: Graph, ranges: DataFrame) -> DataFrame:
    """(row, col, v, beg, end): offsets of every vertex of the row, in each of its partitions."""
    deg = assign(g, ranges).groupBy("row", "col", F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    every = ranges.select("row", "col", F.explode(F.when(F.col("row_end") > F.col("row_beg"), F.sequence(F.floor(F.col("row_beg") / RANGE), F.floor((F.col("row_end") - 1) / RANGE)))).alias("_part"), "row_beg", "row_end")
    lo, hi = F.greatest(F.col("_part") * RANGE, F.col("row_beg")), F.least((F.col("_part") + 1) * RANGE, F.col("row_end")) - 1
    every = every.select("row", "col", F.explode(F.sequence(lo, hi)).alias("v"))
    full = every.join(deg, ["row", "col", "v"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return prefix_sum(full, "degree", ("row", "col")).select("row", "col", "v", (F.col("cum") - F.col("degree")).alias("beg"), F.col("cum").alias("end"))


def write_layout(g: Graph, ranges: DataFrame, path: str, mode: str = "ignore") -> None:
    """Edges by partition, clustered by source: one folder per (row, col), a file for each range of sources or several."""
    dealt = assign(g, ranges).withColumnsRenamed({"row": "prow", "col": "pcol"}).repartition("prow", "pcol", F.floor(F.col("src") / RANGE))
    dealt.sortWithinPartitions("prow", "pcol", "src", "dst").write.mode(mode).partitionBy("prow", "pcol").parquet(path)


def validate_layout(offsets: DataFrame, counts: DataFrame) -> DataFrame:
    """Partitions whose last offset differs from their number of edges; none if the layout is whole."""
    last = offsets.groupBy("row", "col").agg(F.max("end").alias("last"))
    return last.join(counts, ["row", "col"], "full").filter(F.coalesce("last", F.lit(0)) != F.coalesce("edges", F.lit(0)))


def _spanned(offsets: DataFrame, block: int) -> DataFrame:
    """Vertices with the blocks that their neighbours lie in."""
    some = offsets.filter("end > beg")
    return some.withColumn("blk", F.explode(F.sequence(F.floor(F.col("beg") / block), F.floor((F.col("end") - 1) / block))))


def block_index(g: Graph, block: int = BLOCK) -> DataFrame:
    """(blk, beg_vert): the first vertex whose neighbours reach beyond the block's start; vertex 0 for block 0."""
    first = _spanned(beg_pos(g), block).groupBy("blk").agg(F.min("v").alias("beg_vert"))
    return first.select("blk", F.when(F.col("blk") == 0, 0).otherwise(F.col("beg_vert")).cast("long").alias("beg_vert"))


def frontier_blocks(g: Graph, active: Column, block: int = BLOCK) -> DataFrame:
    """(blk): the blocks that the neighbours of active vertices lie in; ``active`` is a predicate over v."""
    return _spanned(beg_pos(g).filter(active), block).select("blk").distinct()


def block_chunks(blocks: DataFrame, most: int, useless: int, in_total: bool = False, group: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, blk_beg, blk_end, requested): requested blocks merged into reads, file by file.

    A chunk ends before a block that would make it longer than ``most``, or at a gap: with ``in_total`` once ``useless``
    unrequested blocks have been passed in all, otherwise at a distance of ``useless`` from the last requested block.
    Greedy and sequential, but a gap that ends any chunk starts afresh: files (``group``) are cut there into stretches,
    which are walked by as many tasks as there are; only a stretch is walked by one.
    """
    names = list(group)
    rows = blocks.select(*(F.col(c).cast("long") for c in group), F.col("blk").cast("long")).distinct().withColumn("_part", F.floor(F.col("blk") / RANGE))
    # the block before each one: within its range, or the last of an earlier range
    last = rows.groupBy(*names, "_part").agg(F.max("blk").alias("_last"))
    before = last.select(*names, "_part", F.lag("_last").over(Window.partitionBy(*names).orderBy("_part")).alias("_before"))
    prior = F.coalesce(F.lag("blk").over(Window.partitionBy(*names, "_part").orderBy("blk")), F.col("_before"))
    ends = F.coalesce(F.col("blk") - prior >= min(most, useless + 1 if in_total else useless), F.lit(False))
    marked = rows.join(before, [*names, "_part"]).withColumn("_cut", ends.cast("long")).drop("_part", "_before")
    dealt = prefix_sum(marked, "_cut", group, "blk", "_stretch").select(*names, "_stretch", "blk").repartition(*names, "_stretch")
    schema = [*names, "blk_beg", "blk_end", "requested"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = None, None

        def made(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema)

        for batch in batches:
            done = []
            for *k, b in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ and k == key:
                    beg, end, n, gap = open_
                    passed = gap + b - end
                    if b + 1 - beg <= most and (passed < useless if in_total else b - end + 1 < useless):
                        open_ = (beg, b + 1, n + 1, passed)
                        continue
                if open_:
                    done.append((*key[:-1], *open_[:3]))
                key, open_ = k, (b, b + 1, 1, 0)
            yield made(done)
        if open_:
            yield made([(*key[:-1], *open_[:3])])

    chunks = dealt.sortWithinPartitions(*names, "_stretch", "blk").mapInArrow(walk, ", ".join(f"{c} bigint" for c in schema))
    numbered = prefix_sum(chunks.withColumn("_one", F.lit(1).cast("long")), "_one", group, "blk_beg", "chunk")
    return numbered.select(*names, (F.col("chunk") - 1).alias("chunk"), "blk_beg", "blk_end", "requested")
