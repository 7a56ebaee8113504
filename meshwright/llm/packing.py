"""Best-fit packing of documents into fixed-length training sequences.

Method: bounded-space online best fit. A fixed number of bins stay open; a
bitset keyed by free space finds the fullest bin that still takes a piece; when
one bin too many would be open, the fullest closes.

Tokenising is a map over the input. Only piece lengths (not token ids, unless
asked for) are shuffled, into parts that are packed independently; each part
wastes at most its open bins.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import small_batches

MAX_LENGTH = 2048
OPEN_BINS = 2048
#: Documents to a packing part.
PART_DOCS = 150_000
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class BestFit:
    """``place(length) -> (bin, offset)`` with at most ``open_bins`` bins open at a time."""

    def __init__(self, capacity: int = MAX_LENGTH, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f is set if an open bin has f free
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def _pop(self, f: int) -> int:
        stack = self.stacks[f]
        b = stack.pop()
        if not stack:
            self.free &= ~(1 << f)
        self.n_open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens does not fit in {self.capacity}")
        fitting = self.free >> length
        if fitting:
            f = length + (fitting & -fitting).bit_length() - 1
            b = self._pop(f)
        else:
            f, b = self.capacity, self.n_bins
            self.n_bins += 1
        left = f - length
        if left:
            if self.n_open >= self.open_bins:  # the fullest closes first, this one included
                fullest = (self.free & -self.free).bit_length() - 1
                if left <= fullest:
                    return b, self.capacity - f
                self._pop(fullest)
            self.stacks[left].append(b)
            self.free |= 1 << left
            self.n_open += 1
        return b, self.capacity - f


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others follow from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(2)
def encoder(path: str):
    """``text -> uint32 ids``, equal to the tokenizers library's ids for the byte-level BPE file at ``path``.

    The same vocabulary as ranks runs some five times faster; it is used only if the file's merges are in the order of
    their ids and both agree on a probe. Texts with a special token's string always go through the library itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    raw = json.load(open(path, encoding="utf-8"))
    special = [t["content"] for t in raw.get("added_tokens", [])]

    def exact(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    try:
        import tiktoken

        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in raw["model"]["vocab"].items() if t not in special}
        merged = [raw["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in raw["model"]["merges"]]
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        probe = "It's  a probe:\n\n 12,345 naïve “words” \t über 東京 🙂!!  \x00 ABC's we'll\r\n "
        if merged != sorted(merged) or fast.encode_ordinary(probe) != exact(probe).tolist():
            return exact
    except (ImportError, KeyError, ValueError):
        return exact

    def quick(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return exact(text)
        return fast.encode_to_numpy(text, disallowed_special=())

    return quick


def pieces(docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Token pieces of each document: its ids, then ``end_id``; longer ones are cut, the first piece taking the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % max_length or max_length
                at = 0
                for piece, end in enumerate(range(first, len(ids) + 1, max_length)):
                    data = ids[at:end].tobytes()
                    for column, value in zip(out, (doc, piece, at, end - at, zlib.crc32(data), data)):
                        column.append(value)
                    at = end
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:n], kinds)], names[:n])

    chosen = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return chosen.mapInArrow(cut, SCHEMA + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, open_bins: int = OPEN_BINS, end_id: int = 0, with_ids: bool = False, part_docs: int = PART_DOCS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``with_ids`` adds the ids (little-endian uint32).

    A null or empty text is the end id alone. Repeated rows are packed as often as they come (two copies of a doc_id
    may lie in any sequences). A null doc_id stays null. Other columns are not used, whatever their names; an empty
    table gives no rows. Offsets in a sequence are gapless from 0.
    """
    cut = pieces(docs, tokenizer, max_length, end_id, with_ids)
    parts = max(1, -(-docs.count() // part_docs))
    dealt = cut.withColumn("_order", F.xxhash64("doc_id", "start", "ids_crc32")).repartition(parts, "_order").sortWithinPartitions("_order", "doc_id", "piece")
    names = [c for c in dealt.columns if c != "_order"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = BestFit(max_length, open_bins)
        for batch in batches:
            where = [bins.place(n) for n in batch.column("length").to_pylist()]
            columns = [batch.column(n) for n in names] + [pa.array([base + b for b, _ in where], pa.int64()), pa.array([o for _, o in where], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = SCHEMA + (", ids binary" if with_ids else "") + ", sequence_id bigint, offset bigint"
    return dealt.mapInArrow(place, schema)
