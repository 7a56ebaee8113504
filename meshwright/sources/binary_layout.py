"""The flat binary files of a two-dimensional CSR layout, for exchange with programs that map them.

Little-endian: ``<prefix>_beg.i_j_of_RxC.bin`` holds i64 offsets (one more than
the row has vertices, from 0), ``<prefix>_csr.i_j_of_RxC.bin`` u32 neighbour
ids, ``<prefix>_beg-RxC-row-ranger.bin`` u32 row boundaries,
``<prefix>_beg-RxC-col-ranger.bin`` u32 column boundaries row by row,
``<prefix>-glb-vert-edge-count.bin`` u32 smallest id, u32 largest id and i64
edge count. Block traces hold i64 block ids. Within Spark, Parquet
(``layout.write_layout``) is the better choice: these files hold a partition
each, and a partition is read by one task. They are made in parts of a range of
sources each, which one task per file then writes one after the other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import layout
from meshwright.operators.graph import Graph, stats

from .flat_files import write_files

PART = r"_(beg|csr)\.(\d+)_(\d+)_of_(\d+)x(\d+)\.bin$"


def layout_files(g: Graph, ranges: DataFrame, prefix: str) -> DataFrame:
    """(name, part, content): every file of the layout in parts, each of the sources of one range. Ids must fit 32 bits."""
    rows, cols = (ranges.agg(F.max(c)).first()[0] + 1 for c in ("row", "col"))
    part = lambda v: F.floor(F.col(v) / layout.RANGE).alias("part")
    beg = layout.partition_beg_pos(g, ranges).groupBy("row", "col", part("v")).agg(F.sort_array(F.collect_list(F.struct("v", "end"))).alias("x"))
    csr = layout.assign(g, ranges).groupBy("row", "col", part("src")).agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("x"))
    name = lambda kind: F.format_string(f"{prefix}_{kind}.%d_%d_of_{rows}x{cols}.bin", "row", "col")
    none = F.array().cast("array<bigint>")
    first = ranges.select("row", "col", F.lit(-1).cast("long").alias("part"))  # each file begins with a part of its own: the leading 0, or nothing

    def pack(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = []
                for values, at in zip(b.column(2).to_pylist(), b.column(1).to_pylist()):
                    v = np.array([0] if at < 0 and kind == "beg" else values, np.int64)
                    if kind == "csr" and len(v) and not 0 <= v.min() <= v.max() < 2**32:
                        raise ValueError("ids need more than 32 bits")
                    cells.append(v.astype("<u4" if kind == "csr" else "<i8").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.binary())], ["name", "part", "content"])

        return run

    out = None
    for kind, frame, field in (("beg", beg, "end"), ("csr", csr, "dst")):
        full = frame.select("row", "col", "part", F.transform("x", lambda s: s[field]).alias("x")).union(first.withColumn("x", none))
        made = full.select(name(kind).alias("name"), "part", "x").mapInArrow(pack(kind), "name string, part bigint, content binary")
        out = made if out is None else out.union(made)
    return out


def write_layout_files(g: Graph, ranges: DataFrame, path: str, prefix: str = "graph") -> list[str]:
    """Writes all files of the layout, the small ones among them; their names."""
    cells = layout_files(g, ranges, prefix).repartition("name").sortWithinPartitions("name", "part")
    made = write_files(cells.select("name", "content"), path)
    small = [(n, bytearray(c)) for n, c in small_files(g, ranges, prefix).items()]
    return sorted(made + write_files(g.edges.sparkSession.createDataFrame(small, "name string, content binary").coalesce(1), path))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, row_beg, row_end, col_beg, col_end) from the range files of a folder; as many rows as its partitions."""
    rows, cols = (np.frombuffer(spark.read.format("binaryFile").load(f"{path}/*-{kind}-ranger.bin").first()["content"], "<u4").tolist() for kind in ("row", "col"))
    n = len(cols) // (len(rows) - 1)
    made = [(i, j, rows[i], rows[i + 1], cols[i * n + j], cols[i * n + j + 1]) for i in range(len(rows) - 1) for j in range(n - 1)]
    return spark.createDataFrame(made, "row long, col long, row_beg long, row_end long, col_beg long, col_end long")


def read_layout_files(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) from all files of a layout, its range files giving the row boundaries."""
    starts = [r["row_beg"] for r in read_ranges(spark, path).filter("col = 0").orderBy("row").collect()]  # a number per row
    return edges_of_layout(spark.read.format("binaryFile").load(f"{path}/*.bin"), starts)


def small_files(g: Graph, ranges: DataFrame, prefix: str) -> dict[str, bytes]:
    """Metadata and range files: a few numbers each, as many as the partition's parameters say."""
    s = stats(g.edges).first()
    r = ranges.orderBy("row", "col").collect()
    rows, cols = r[-1]["row"] + 1, r[-1]["col"] + 1
    starts = [r[i * cols]["row_beg"] for i in range(rows)] + [g.n]
    columns = [x for i in range(rows) for x in [*(r[i * cols + j]["col_beg"] for j in range(cols)), g.n]]
    return {
        f"{prefix}-glb-vert-edge-count.bin": struct.pack("<IIq", s["min_vert"], s["max_vert"], s["edge_count"]),
        f"{prefix}_beg-{rows}x{cols}-row-ranger.bin": np.array(starts, "<u4").tobytes(),
        f"{prefix}_beg-{rows}x{cols}-col-ranger.bin": np.array(columns, "<u4").tobytes(),
    }


def read_metadata(content: bytes) -> dict[str, int]:
    """Smallest and largest id and edge count; an empty or inconsistent record is refused."""
    low, high, edges = struct.unpack("<IIq", content)
    if low >= high or edges <= 0:
        raise ValueError("metadata out of order")
    return {"min_vert": low, "max_vert": high, "edge_count": edges}


def edges_of_layout(files: DataFrame, row_starts: list[int]) -> DataFrame:
    """(src, dst) from layout files (path, content), as ``spark.read.format("binaryFile")`` gives them.

    ``row_starts`` are the row boundaries. A partition whose last offset differs from its number of neighbours is refused.
    """
    part = lambda i: F.regexp_extract("path", PART, i)
    named = files.select(part(1).alias("kind"), part(2).cast("int").alias("row"), part(3).cast("int").alias("col"), "content").filter("kind <> ''")
    both = named.groupBy("row", "col").agg(F.max(F.when(F.col("kind") == "beg", F.col("content"))).alias("beg"), F.max(F.when(F.col("kind") == "csr", F.col("content"))).alias("csr"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, beg, csr in zip(*(b.column(c).to_pylist() for c in ("row", "beg", "csr"))):
                at, dst = np.frombuffer(beg, "<i8"), np.frombuffer(csr, "<u4").astype(np.int64)
                if at[-1] != len(dst):
                    raise ValueError(f"{at[-1]} offsets for {len(dst)} neighbours")
                src = row_starts[row] + np.repeat(np.arange(len(at) - 1), np.diff(at))
                for i in range(0, len(dst), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(src[i : i + (1 << 16)], pa.int64()), pa.array(dst[i : i + (1 << 16)])], ["src", "dst"])

    return both.mapInArrow(unpack, "src bigint, dst bigint")


def read_block_trace(spark: SparkSession, path: str, total_blocks: int, distinct: bool = True) -> DataFrame:
    """(blk) of trace files; ids from ``total_blocks`` on are dropped. ``distinct`` is the bitmap form."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0).to_pylist():
                ids = np.frombuffer(cell, "<i8")
                for i in range(0, len(ids), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 16)])], ["blk"])

    blocks = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "blk bigint").filter(F.col("blk") < total_blocks)
    return blocks.distinct() if distinct else blocks
