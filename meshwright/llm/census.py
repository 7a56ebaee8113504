"""Counting 64-bit gram hashes over a whole corpus, and telling each chunk of documents which of its own are shared.

Documents are dealt once into chunks of some MB. A chunk sends its distinct
hashes with their counts, packed, to hash ranges; a range sums them and sends
each chunk back its hashes whose total is 2 or more. A hash that a third of all
documents hold takes one entry per chunk, never one per document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import parts, small_batches
from .words import U64, bucket_of, pack_sorted, planes, unpack_sorted, unplanes

#: Chunks and hash ranges for each 16 MB of stored input.
CHUNKS, RANGES = 8, 4


def chunked(docs: DataFrame, size: int | None = None) -> DataFrame:
    """(doc_id, text, _key): the documents dealt into chunks, CHUNKS for each of ``size`` parts; rows of equal id and text share one."""
    keys = (size or parts(docs)) * CHUNKS
    docs = small_batches(docs)
    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return chosen.withColumn("_key", F.pmod(F.xxhash64("doc_id", "text"), F.lit(keys)).cast("int")).repartition("_key")


def shared(dealt: DataFrame, hashes: Callable[[pa.ChunkedArray], np.ndarray], ranges: int) -> DataFrame:
    """(_key, h, n): packed hashes of a chunk that occur twice or more in all chunks, ascending, and their totals."""

    def count(table: pa.Table) -> pa.Table:
        found, n = np.unique(hashes(table.column("text")), return_counts=True)
        cut = np.searchsorted(bucket_of(found, ranges), np.arange(ranges + 1).astype(U64))
        rows = [(b, pack_sorted(found[i:j]), planes(np.minimum(n[i:j], 2**32 - 1), 4)) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if j > i]
        b, h, c = zip(*rows) if rows else ((), (), ())
        key = table.column("_key")[0].as_py()
        return pa.table([pa.array(b, pa.int32()), pa.array([key] * len(b), pa.int32()), pa.array(h, pa.binary()), pa.array(c, pa.binary())], ["range", "_key", "h", "n"])

    def total(table: pa.Table) -> pa.Table:
        sets = [unpack_sorted(h) for h in table.column("h").to_pylist()]
        every = np.concatenate(sets)
        n = np.concatenate([unplanes(c, 4) for c in table.column("n").to_pylist()])
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        n = np.minimum(np.add.reduceat(n[order], first), U64(2**32 - 1))
        known, n = every[first][n > 1], n[n > 1]
        keys, h, c = [], [], []
        for key, own in zip(table.column("_key").to_pylist(), sets):
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            hit = known[at] == own if len(known) else np.zeros(len(own), bool)
            if hit.any():
                keys.append(key)
                h.append(pack_sorted(own[hit]))
                c.append(planes(n[at[hit]], 4))
        return pa.table([pa.array(keys, pa.int32()), pa.array(h, pa.binary()), pa.array(c, pa.binary())], ["_key", "h", "n"])

    sent = dealt.groupBy("_key").applyInArrow(count, "range int, _key int, h binary, n binary")
    return sent.groupBy("range").applyInArrow(total, "_key int, h binary, n binary")


def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and totals that came back to one chunk, ascending."""
    if not table.num_rows:
        return np.zeros(0, U64), np.zeros(0, U64)
    h = np.concatenate([unpack_sorted(x) for x in table.column("h").to_pylist()])
    n = np.concatenate([unplanes(x, 4) for x in table.column("n").to_pylist()])
    order = np.argsort(h)
    return h[order], n[order]
