"""Removal of passages that occur more than once.

Method: Rabin-Karp hashes of every window of a fixed number of words, counted
over the whole corpus; words under any repeated window merge into maximal
removal intervals. Windows are judged on the input, all occurrences go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import census
from .sizing import parts
from .words import slices, spans, text_buffers, window_hashes, word_hashes

WINDOW = 35
#: Bytes of text hashed at a time.
SLICE = 1 << 20


def _windows(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word, hash of each window, and the index of its first word."""
    starts, ends, row = spans(raw, off)
    h, at = window_hashes(word_hashes(raw, starts, ends), row, k)
    return row, h, at


def _all_windows(column: pa.ChunkedArray, k: int) -> np.ndarray:
    raw, off = text_buffers(column)
    out = [_windows(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)[1] for i, j in slices(off, SLICE)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, removed (array of word intervals, ends exclusive, maximal and ascending), text (the kept words, joined by one space).

    A word goes if a window of ``window`` words over it also starts anywhere else, in its own document too; so all of a
    repeated row goes, once it has that many words. Null and empty texts have no words. Null ids stay null; other
    columns are not used; an empty table gives no rows. Windows are told apart by 64-bit hashes.
    """
    dealt = census.chunked(docs)
    found = census.shared(dealt, lambda c: _all_windows(c, window), parts(docs) * census.RANGES)

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        known, _ = census.gathered(told)
        raw, off = text_buffers(table.column("text"))
        n_words, removed, kept = [], [], []
        for i, j in slices(off, SLICE):
            part, own = raw[off[i] : off[j]], off[i : j + 1] - off[i]
            row, h, at = _windows(part, own, window)
            pos = np.searchsorted(known, h)
            pos[pos == len(known)] = 0
            again = at[known[pos] == h] if len(known) else at[:0]
            edge = np.bincount(again, minlength=len(row) + 1) - np.bincount(again + window, minlength=len(row) + 1)[: len(row) + 1]
            gone = np.cumsum(edge)[: len(row)] > 0
            first = np.searchsorted(row, np.arange(j - i + 1))
            touched = np.zeros(j - i, bool)
            touched[row[gone]] = True
            data = part.tobytes()
            for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                words = data[own[d] : own[d + 1]].split()
                intervals = []
                if touched[d]:
                    keep = ~gone[a:b]
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                    cut = np.flatnonzero(np.diff(np.concatenate([[0], (~keep).view(np.int8), [0]]))).tolist()
                    intervals = [{"start": s, "end": e} for s, e in zip(cut[::2], cut[1::2])]
                n_words.append(b - a)
                removed.append(intervals)
                kept.append(b" ".join(words))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([table.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "removed", "text"])

    schema = "doc_id bigint, n_words bigint, removed array<struct<start:bigint,end:bigint>>, text string"
    return dealt.groupBy("_key").cogroup(found.groupBy("_key")).applyInArrow(remove, schema)
