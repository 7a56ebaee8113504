"""What the two classifiers share: the rows that labels may be learned from, and scoring text in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import Columns
from .sizing import small_batches
from .words import slices, text_buffers

#: Bytes of text scored at a time.
SLICE = 1 << 19


def held_out(modulus: int, rest: int):
    """Whether a row is kept from learning, by crc32 of its id as text. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == rest


def drawn(labels: DataFrame, target: str, modulus: int, rest: int, rows: int) -> DataFrame:
    """(doc_id, y): at most ``rows`` labelled rows that may be learned from, in the order of a hash of their ids; an id counts once."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[target].cast("int").alias("y"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).filter(~held_out(modulus, rest))
    return known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sample(docs: DataFrame, chosen: DataFrame, extract: Callable[[np.ndarray, np.ndarray], list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """Features and labels of the drawn rows. ``chosen`` is bounded by its limit, so it can be broadcast; only features reach the driver.

    An id that repeats gives one row, that with the smallest text hash, before anything is collected.
    """
    own = Columns(docs)
    kept = small_batches(own.rows).select(own["doc_id"].cast("long").alias("doc_id"), own["text"].cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    kept = kept.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.max("y").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            for i, j in slices(off, SLICE):
                made = extract(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(made, pa.binary()), batch.column(2)[i:j]], ["doc_id", "f", "y"])

    rows = kept.mapInArrow(run, "doc_id bigint, f binary, y int").toPandas().sort_values("doc_id")
    return list(rows["f"]), rows["y"].to_numpy(int)


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], modulus: int, rest: int, threshold: float) -> DataFrame:
    """All columns of ``docs`` plus held_out, score and predicted (1 if score >= threshold)."""
    given = Columns(docs, ("held_out", "score", "predicted"))
    chosen = small_batches(given.rows).select(*given.kept(), given["doc_id"].alias("doc_id"), given["text"].cast("string").alias("text"))
    names = [*chosen.columns[:-1], "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(batch.num_columns - 1))
            out = [score(raw[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in slices(off, SLICE)]
            column = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema[:-1]) + ", score double"
    out = chosen.mapInArrow(run, schema)
    out = out.withColumn("held_out", held_out(modulus, rest)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return given.named(out, "held_out", "score", "predicted")
