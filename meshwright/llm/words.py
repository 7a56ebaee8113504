"""Vectorised word, shingle and window hashing over Arrow text batches.

A *word* is a run of bytes outside ``\\x20\\x09-\\x0D``; UTF-8 multi-byte
characters never contain those bytes, so byte runs equal character runs.
Everything works on the concatenated UTF-8 buffer of many texts at once; the
only per-text work is the sort of its shingles.

A word's hash is a sum over its 8-byte lanes, each mixed with its place in a
non-linear way, so that no two words collide by their structure (polynomials
modulo 2**64 do, for words such as Thue-Morse strings). Windows of words are
Rabin-Karp hashed: polynomials in the words' mixed hashes, of a degree below the
window's length, finished with a mixing step. Two given different words
collide with probability about 2**-64; two given different windows too, but for
windows that arrange the same few words so that the polynomial of their
difference has many factors of two: at 35 words the worst such pair, two words in
Thue-Morse order, keeps 44 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GRAM = 0xD1342543DE82EF95 | 1
_INVERSE = {b: pow(b, -1, 1 << 64) for b in (_GRAM,)}
#: Added to a lane for each lane before it in its word, and to a word's sum for each byte.
_LANE, _LENGTH = U64(0x9E3779B97F4A7C15), U64(0xA0761D6478BD642F)
#: The bytes of a lane that belong to a word of 0 to 8 remaining bytes.
_HELD = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: The bytes that separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """``base**i`` (or its inverse) modulo 2**64 for i < n, cached and grown by doubling."""
    got = _powers.get((base, inverse))
    if got is None or len(got) < n:
        b = _INVERSE[base] if inverse else base
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        got = np.ones(1, U64)
        while len(got) < size:
            got = np.concatenate([got, got * U64(pow(b, len(got), 1 << 64))])
        _powers[base, inverse] = got
    return got[:n]


def avalanche(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values, so that equal top or low bits are no likelier than chance."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes (one row at least): the working memory is bounded by it and the longest text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows. ``between`` marks the bytes that separate words."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    word = ~between[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0], before[1:] = False, word
    after = before[1:].copy()
    after[:-1], after[-1] = word[1:], False
    before = before[:-1].copy()
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _folded(raw: np.ndarray) -> np.ndarray:
    """``raw`` with A-Z in lower case."""
    return raw + (((raw - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` folds A-Z."""
    padded = np.concatenate([_folded(raw) if lower else raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(raw) + 1, "<u8", padded.data, strides=(1,))
    size = ends - starts
    h = avalanche((lanes[starts] & _HELD[np.minimum(size, 8)]) + _LANE)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3  # lanes after the first
        of = np.repeat(long, more)
        place = ragged(np.ones(len(long), np.int64), more)
        left = np.minimum(size[of] - 8 * place, 8)
        mixed = avalanche((lanes[starts[of] + 8 * place] & _HELD[left]) + (place + 1).astype(U64) * _LANE)
        h[long] += np.add.reduceat(mixed, np.cumsum(more) - more)
    return avalanche(h + size.astype(U64) * _LENGTH)


def ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges."""
    return np.arange(int(lengths.sum())) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)


def window_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every ``k`` consecutive words of one row, and the index of each window's first word."""
    if len(h) < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(_GRAM, len(h)), out=sums[1:])
    at = np.flatnonzero(row[: len(h) - k + 1] == row[k - 1 :])
    return avalanche((sums[at + k] - sums[at]) * powers(_GRAM, len(h) + 1, True)[at]), at


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each row, concatenated, and the bounds of each row's set.

    A row with 1 to k-1 words has one shingle, the whole sequence; a row without words has none.
    """
    n = len(offsets) - 1
    starts, ends, row = spans(raw, offsets)
    h = word_hashes(raw, starts, ends, True)
    grams, at = window_hashes(h, row, k)
    of = row[at]
    count = np.bincount(row, minlength=n)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        sums = np.zeros(len(h) + 1, U64)
        np.cumsum(h * powers(_GRAM, len(h)), out=sums[1:])
        first = np.concatenate([[0], np.cumsum(count)])
        whole = (sums[first[short + 1]] - sums[first[short]]) * powers(_GRAM, len(h) + 1, True)[first[short]]
        whole = avalanche(whole + count[short].astype(U64) * U64(0xE7037ED1A0B428DB))
        grams, of = np.concatenate([grams, whole]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
    bounds = np.searchsorted(of, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            grams[a:b].sort()
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[keep], of[keep]
    return grams, np.searchsorted(of, np.arange(n + 1))


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte plane by byte plane: the high planes are zeros, which the shuffle's codec removes."""
    d = np.array(values, "<u8")
    d[1:] -= d[:-1].copy()
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    d = np.frombuffer(data, np.uint8).reshape(8, -1).T.copy()
    return np.cumsum(d.view("<u8").ravel().astype(U64), dtype=U64)


def planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers below 256**width, byte plane by byte plane."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int) -> np.ndarray:
    d = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((d.shape[1], 8), np.uint8)
    out[:, :width] = d.T
    return out.view("<u8").ravel()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The hash range that a value falls in, by its top 32 bits."""
    return ((h >> U64(32)) * U64(buckets)) >> U64(32)
