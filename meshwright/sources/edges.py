"""Edge sources and sinks: text, packed binary and Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat_files import write_files

#: Bytes of one packed edge: two little-endian 64-bit integers.
EDGE_BYTES = 16
COMMENTS = ("%", "#")


def parse_edge_lines(lines: DataFrame, value: Column | str = "value") -> DataFrame:
    """(src, dst) of text lines: the first two whitespace-separated integers.

    Comment and blank lines are skipped, and lines whose first two tokens aren't integers of 64 bits; further tokens
    (weights) are ignored. Works on batch and streaming frames alike.
    """
    text = F.trim(F.regexp_replace(F.col(value) if isinstance(value, str) else value, r"\s+", " "))
    token = F.split(text, " ")
    rows = lines.filter(~F.substring(text, 1, 1).isin(*COMMENTS)).select(token.alias("_t"))
    number = lambda i: F.when(F.get("_t", F.lit(i)).rlike(r"^[+-]?[0-9]+$"), F.get("_t", F.lit(i)).try_cast("bigint"))
    pair = rows.select(number(0).alias("src"), number(1).alias("dst"))
    return pair.dropna()


def read_text_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_edge_lines(spark.read.text(path))


def write_text_edges(edges: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """One edge a line; ``files`` deals them evenly into so many files."""
    edges = edges.repartition(files) if files else edges
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode(mode).text(path)


def write_binary_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Packed edges, one binary cell of 16-byte records per Arrow batch, in Parquet; ``pack_edges`` gives the same cells."""
    pack_edges(edges).write.mode(mode).parquet(path)


def pack_edges(edges: DataFrame) -> DataFrame:
    """(content): packed 16-byte records, a cell per batch of rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                both = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)], 1)
                yield pa.RecordBatch.from_arrays([pa.array([both.astype("<i8").tobytes()], pa.binary())], ["content"])

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).dropna().mapInArrow(pack, "content binary")


def write_edge_files(edges: DataFrame, path: str, prefix: str = "edges") -> list[str]:
    """Packed edges as flat files ``<prefix>-00000.bin`` and so on, one for each partition that holds any; their names."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{prefix}-{TaskContext.get().partitionId():05d}.bin"
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows, pa.string()), b.column(0)], ["name", "content"])

    return write_files(pack_edges(edges).mapInArrow(named, "name string, content binary"), path)


def unpack_edges(packed: DataFrame, content: str = "content", piece: int = 1 << 16) -> DataFrame:
    """(src, dst) of packed cells; a cell whose length isn't a multiple of 16 fails the job. Yields batches of bounded size."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell in b.column(0).to_pylist():
                if cell is None:
                    continue
                if len(cell) % EDGE_BYTES:
                    raise ValueError(f"{len(cell)} bytes are not whole edges")
                both = np.frombuffer(cell, "<i8").reshape(-1, 2)
                for i in range(0, len(both), piece):
                    part = both[i : i + piece]
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["src", "dst"])

    return packed.select(content).mapInArrow(unpack, "src bigint, dst bigint")


def read_binary_edges(spark: SparkSession, path: str) -> DataFrame:
    """Packed edge files (``*.bin``), or the Parquet cells that ``write_binary_edges`` makes."""
    if path.endswith(".bin") or "*" in path:
        return unpack_edges(spark.read.format("binaryFile").load(path))
    return unpack_edges(spark.read.parquet(path))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; loops once."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").union(back)


def dedupe(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()
