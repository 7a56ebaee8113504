"""What a traversal asks of a layout's blocks: queues, chunks of a scan, clipped neighbour ranges, bytes per level.

Queues are numbered by the two-level prefix sum, chunks meet vertices by their blocks, an equi-join: no task sees all
vertices, all blocks or all neighbours of a hub.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import Graph
from .layout import BLOCK, _spanned, assign, beg_pos, block_chunks, block_index, prefix_sum

#: Bytes of a neighbour id; requests that are sorted together.
ID_BYTES, RUN = 8, 16


def queue(vertices: DataFrame, active: Column) -> DataFrame:
    """(place, v): the active vertices in ascending order, places from 0; repeated vertices count once."""
    some = vertices.filter(active).select("v").distinct().withColumn("one", F.lit(1))
    return prefix_sum(some, "one").select((F.col("cum") - 1).alias("place"), "v")


def sorted_runs(trace: DataFrame, at: str, value: str, run: int = RUN) -> DataFrame:
    """The trace with each run of ``run`` consecutive places sorted by value; the last run may be shorter."""
    begin = F.floor(F.col(at) / run) * run
    place = F.row_number().over(Window.partitionBy("_run").orderBy(value))
    return trace.withColumn("_run", begin).select((F.col("_run") + place - 1).alias(at), value)


def preview(g: Graph, ranges: DataFrame, most: int = 10) -> DataFrame:
    """(row, col, place, src, dst): each partition's first edges by source; shorter partitions have fewer."""
    place = F.row_number().over(Window.partitionBy("row", "col").orderBy("src", "dst"))
    first = assign(g, ranges).withColumn("place", place).filter(F.col("place") <= most)
    return first.select("row", "col", (F.col("place") - 1).cast("long").alias("place"), "src", "dst")


def overlaps(ranges: DataFrame) -> DataFrame:
    """(row, col, other): the row strips that a partition's columns reach into; both sides are as many as the parameters say."""
    strips = F.broadcast(ranges.select(F.col("row").alias("other"), F.col("row_beg").alias("beg"), F.col("row_end").alias("end")).distinct())
    meet = (F.col("col_beg") < F.col("end")) & (F.col("beg") < F.col("col_end")) & (F.col("beg") < F.col("end")) & (F.col("col_beg") < F.col("col_end"))
    return ranges.join(strips, meet).select("row", "col", "other")


def scan_chunks(g: Graph, most: int, block: int = BLOCK) -> DataFrame:
    """(chunk, blk_beg, blk_end, beg_vert): all blocks in chunks of ``most``, the last one of what is left, with the first vertex of each."""
    total = -(-g.edges.count() // block)
    first = block_index(g, block).filter(F.col("blk") % most == 0).withColumnRenamed("blk", "blk_beg")
    return first.select(F.floor(F.col("blk_beg") / most).alias("chunk"), "blk_beg", F.least(F.col("blk_beg") + most, F.lit(total)).alias("blk_end"), "beg_vert")


def clipped(offsets: DataFrame, chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(chunk, v, beg, end): where each vertex's neighbours lie in the chunks that hold any, from the chunk's own start on."""
    held = chunks.select("chunk", "blk_beg", "blk_end", F.explode(F.sequence("blk_beg", F.col("blk_end") - 1)).alias("blk"))
    met = _spanned(offsets, block).join(held, "blk").groupBy("chunk", "v").agg(*[F.first(c).alias(c) for c in ("beg", "end", "blk_beg", "blk_end")])
    start = F.col("blk_beg") * block
    size = (F.col("blk_end") - F.col("blk_beg")) * block
    return met.select("chunk", "v", F.greatest(F.col("beg") - start, F.lit(0)).alias("beg"), F.least(F.col("end") - start, size).alias("end"))


def level_bytes(g: Graph, levels: DataFrame, most: int, useless: int, block: int = BLOCK) -> DataFrame:
    """(level, blocks, chunks, bytes): what each level of a traversal asks for, and what its merged reads fetch."""
    asked = _spanned(beg_pos(g).join(levels.select("v", "level"), "v"), block).select("level", "blk").distinct()
    chunks = block_chunks(asked, most, useless, True, ("level",))
    fetched = F.sum(F.col("blk_end") - F.col("blk_beg")) * block * ID_BYTES
    return chunks.groupBy("level").agg(F.sum("requested").alias("blocks"), F.count(F.lit(1)).alias("chunks"), fetched.alias("bytes")).select(F.col("level").cast("int").alias("level"), "blocks", "chunks", "bytes")
