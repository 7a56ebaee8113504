"""FLAC media columns: a lossless encoder and a decoder that verifies every checksum.

Frames of many streams are coded side by side: step t of the loop handles
sample t of every frame, so the cost is a few array operations per sample
index, however many streams there are. A stream is walked frame by frame: the
next one begins where the bits of the last one end and its CRC-16 closes. Only
behind a damaged frame is the next one searched for, by sync code, CRC-8 and frame
number. To work side by side, every place that looks like a header is decoded
ahead; the walk takes those that it comes to.

Supported: mono, 4 to 24 bits, constant, verbatim, fixed and LPC subframes, both
Rice codings with any partition order and escapes, fixed block size.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import Columns
from .sizing import small_batches
from .words import slices, text_buffers

BLOCK = 192
RATE = 8000
#: Bytes of payload or stream coded at a time; the working memory is some tens of times that, besides a text's own bytes.
SLICE = 1 << 19

# Fixed values of the format.
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
SIZES = {1: 192} | {n: 576 << (n - 2) for n in range(2, 6)} | {n: 256 << (n - 8) for n in range(8, 16)}


def _table(poly: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) else 0)
        out.append(c & ((1 << bits) - 1))
    return np.array(out, np.uint32)


_CRC8, _CRC16 = _table(0x107, 8), _table(0x18005, 16)


def _crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, wide: bool) -> np.ndarray:
    """CRC-16 or CRC-8 of many byte ranges at once, the longest first so that finished ranges fall off the end."""
    order = np.argsort(starts - ends, kind="stable")
    at, left = starts[order].copy(), (ends - starts)[order]
    crc = np.zeros(len(at), np.uint32)
    alive = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
    for n in alive.tolist():
        c, b = crc[:n], data[at[:n]]
        crc[:n] = (_CRC16[(c >> 8) ^ b] ^ (c << 8)) & 0xFFFF if wide else _CRC8[c ^ b]
        at[:n] += 1
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for i in range(width):
        bits[at + i] = (value >> (width - 1 - i)) & 1


def _predict(x: np.ndarray, coefs: tuple[int, ...], shift: int) -> np.ndarray:
    """Predictions of samples ``len(coefs)`` on."""
    n, p = x.shape[1], len(coefs)
    out = np.zeros((len(x), n - p), np.int64)
    for j, c in enumerate(coefs):
        out += c * x[:, p - 1 - j : n - 1 - j]
    return out >> shift


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's variable-length code: bytes, padded to 6, and their count."""
    count = 1 + (n >= 1 << 7).astype(np.int64) + (n >= 1 << 11) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26)
    out = np.zeros((len(n), 6), np.uint8)
    for c in range(1, 7):
        own = np.flatnonzero(count == c)
        for j in range(c):
            part = n[own] >> (6 * (c - 1 - j))
            out[own, j] = part if c == 1 else (0x80 | (part & 0x3F)) if j else (0xFF << (8 - c) & 0xFF) | part
    return out, count


def encode_frames(x: np.ndarray, number: np.ndarray, lpc: tuple[tuple[int, ...], int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """8-bit frames of BLOCK samples (rows of ``x``, -128 to 127) as bytes, and the bounds of each.

    Each frame takes the fixed predictor of order 0 to 2 (or ``lpc``: coefficients of up to 8 bits and a shift) and the
    Rice parameter that come out shortest by the sum of its residuals.
    """
    n = len(x)
    x = x.astype(np.int64)
    ways = [(0x08 + p, FIXED[p], 0) for p in (0, 1, 2)] + ([(0x20 + len(lpc[0]) - 1, *lpc)] if lpc else [])
    folded = []
    for _, coefs, shift in ways:
        r = x[:, len(coefs) :] - _predict(x, coefs, shift)
        folded.append((r << 1) ^ (r >> 63))
    sums = np.stack([u.sum(1) + 8 * (BLOCK - u.shape[1]) for u in folded])
    way = np.argmin(sums, 0)
    best = sums[way, np.arange(n)]
    k = np.zeros(n, np.int64)
    for j in range(1, 15):
        k[best >= (BLOCK << j)] = j
    coded, coded_n = _number(number)
    head = 4 + coded_n + 1
    groups, length = [], np.zeros(n, np.int64)
    for w, (kind, coefs, shift) in enumerate(ways):
        for j in np.unique(k[way == w]).tolist():
            own = np.flatnonzero((way == w) & (k == j))
            u = folded[w][own]
            size = (u >> j) + 1 + j
            extra = 9 + len(coefs) * 8 if kind >= 0x20 else 0
            lead = 8 + 8 * len(coefs) + extra + 2 + 4 + 4
            groups.append((own, u, size, j, kind, coefs, shift, lead))
            length[own] = head[own] + (lead + size.sum(1) + 7) // 8 + 2
    ends = np.cumsum(length)
    starts = ends - length
    bits = np.zeros(int(ends[-1]) * 8 if n else 0, np.uint8)
    for own, u, size, j, kind, coefs, shift, lead in groups:
        at = (starts[own] + head[own]) * 8
        _put(bits, at + 1, np.full(len(own), kind), 6)
        at = at + 8
        for t in range(len(coefs)):
            _put(bits, at, x[own, t] & 0xFF, 8)
            at = at + 8
        if kind >= 0x20:
            _put(bits, at, np.full(len(own), 7), 4)
            _put(bits, at + 4, np.full(len(own), shift), 5)
            at = at + 9
            for c in coefs:
                _put(bits, at, np.full(len(own), c & 0xFF), 8)
                at = at + 8
        _put(bits, at + 6, np.full(len(own), j), 4)
        at = (at + 10)[:, None] + np.cumsum(size, 1) - size
        stop = at + (u >> j)
        bits[stop] = 1
        for i in range(j):
            bits[stop + 1 + i] = (u >> (j - 1 - i)) & 1
    data = np.packbits(bits)
    data[starts], data[starts + 1], data[starts + 2], data[starts + 3] = 0xFF, 0xF8, 0x14, 0x02
    for j in range(6):
        own = np.flatnonzero(coded_n > j)
        data[starts[own] + 4 + j] = coded[own, j]
    data[starts + head - 1] = _crc(data, starts, starts + head - 1, False)
    check = _crc(data, starts, ends - 2, True)
    data[ends - 2], data[ends - 1] = check >> 8, check & 0xFF
    return data, np.concatenate([[0], ends])


def encode(payloads: list[bytes], lpc: tuple[tuple[int, ...], int] | None = None) -> list[bytes]:
    """One FLAC stream for each payload of whole blocks; a byte b is the sample b - 128."""
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError(f"payloads must be positive multiples of {BLOCK} bytes")
    if not payloads:
        return []
    x = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    frames = np.array([len(p) // BLOCK for p in payloads])
    first = np.cumsum(frames) - frames
    number = np.arange(len(x)) - np.repeat(first, frames)
    step = SLICE // BLOCK
    pieces = [encode_frames(x[i : i + step], number[i : i + step], lpc) for i in range(0, len(x), step)]
    raw, out = b"".join(d.tobytes() for d, _ in pieces), []
    sizes = np.concatenate([np.diff(b) for _, b in pieces])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for p, f, n in zip(payloads, first.tolist(), frames.tolist()):
        own = sizes[f : f + n]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        packed = (RATE << 44) | (0 << 41) | (7 << 36) | len(p)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
        out.append(b"fLaC" + b"\x80\x00\x00\x22" + info + raw[bounds[f] : bounds[f + n]])
    return out


def _words(data: np.ndarray) -> np.ndarray:
    """The big-endian 64 bits that begin at each byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data) + 1, np.uint64)
    for i in range(8):
        out[: len(data)] |= padded[i : i + len(data)] << np.uint64(56 - 8 * i)
    return out


class _Bits:
    """Reads the bits of many places at once."""

    def __init__(self, data: np.ndarray):
        self.words = _words(data)
        ones = np.unpackbits(data)
        n = len(ones)
        where = np.where(ones, np.arange(n, dtype=np.int32), np.int32(n))
        self.next_one = np.append(np.minimum.accumulate(where[::-1])[::-1], np.int32(n))
        self.n = n

    def read(self, at: np.ndarray, width) -> np.ndarray:
        """``width`` (0 to 32) bits at each place."""
        at = np.minimum(at, self.n)
        w = self.words[at >> 3] << (at & 7).astype(np.uint64)
        return ((w >> np.uint64(1)) >> (np.uint64(63) - np.asarray(width).astype(np.uint64))).astype(np.int64)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        v = self.read(at, width)
        return v - ((v >> (width - 1)) << width)

    def unary(self, at: np.ndarray) -> np.ndarray:
        at = np.minimum(at, self.n)
        return self.next_one[at].astype(np.int64) - at


def _residuals(bits: _Bits, at: np.ndarray, block: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rice-coded residuals of frames that share block size and predictor order, in step; where each ends; which use reserved codes."""
    method, parts = bits.read(at, 2), bits.read(at + 2, 4)
    bad = (method > 1) | ((block >> parts) << parts != block) | ((block >> parts) < order)
    method, parts = np.where(bad, 0, method), np.where(bad, 0, parts)
    width = 4 + method
    at = at + 6
    each = block >> parts
    out = np.zeros((len(at), block - order), np.int64)
    k = raw = np.zeros(len(at), np.int64)
    escape = np.zeros(len(at), bool)
    for t in range(order, block):
        new = np.flatnonzero((t % each == 0) | (t == order))
        if len(new):
            k, raw, escape = k.copy(), raw.copy(), escape.copy()
            k[new] = bits.read(at[new], width[new])
            escape[new] = k[new] == (1 << width[new]) - 1
            at[new] += width[new]
            esc = new[escape[new]]
            if len(esc):
                raw[esc] = bits.read(at[esc], 5)
                at[esc] += 5
                k[esc] = 0
        if escape.any():
            plain, esc = np.flatnonzero(~escape), np.flatnonzero(escape)
            wide = esc[raw[esc] > 0]
            out[wide, t - order] = bits.signed(at[wide], raw[wide])
            at[esc] += raw[esc]
        else:
            plain = slice(None)
        p, kk = at[plain], k[plain]
        q = bits.unary(p)
        p = p + q + 1
        u = (q << kk) | bits.read(p, kk)
        out[plain, t - order] = (u >> 1) ^ -(u & 1)
        at[plain] = p + kk
    return out, at, bad


def _subframes(bits: _Bits, at: np.ndarray, block: int, bps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of frames of one block size and width, their subframes beginning at bit ``at``; the bit after each; which use reserved codes."""
    kind, wasted = bits.read(at + 1, 6), bits.read(at + 7, 1)
    bad = bits.read(at, 1) == 1
    at = at + 8
    extra = np.where(wasted == 1, bits.unary(at) + 1, 0)
    at = at + extra
    bad |= extra >= bps
    extra = np.minimum(extra, bps - 1)
    x = np.zeros((len(at), block), np.int64)
    end = at.copy()
    for form in np.unique(kind * 64 + extra).tolist():
        code, lost = divmod(form, 64)
        own = np.flatnonzero((kind == code) & (extra == lost))
        a, width = at[own], bps - lost
        order = code - 8 if 8 <= code <= 12 else code - 31 if code >= 32 else 0
        if 1 < code < 8 or 12 < code < 32 or order > block:
            bad[own] = True
        elif code == 0:
            x[own] = bits.signed(a, width)[:, None]
            end[own] = a + width
        elif code == 1:
            x[own] = bits.signed(a[:, None] + np.arange(block) * width, width)
            end[own] = a + block * width
        else:
            warm = bits.signed(a[:, None] + np.arange(order) * width, width) if order else np.zeros((len(a), 0), np.int64)
            a = a + order * width
            if code <= 12:
                coefs, shift = np.tile(np.array(FIXED[order], np.int64), (len(a), 1)), np.zeros(len(a), np.int64)
            else:
                precision = bits.read(a, 4) + 1
                shift = bits.signed(a + 4, 5)
                bad[own] |= (precision == 16) | (shift < 0)
                shift = np.maximum(shift, 0)
                a = a + 9
                coefs = bits.signed(a[:, None] + np.arange(order) * precision[:, None], precision[:, None])
                a = a + order * precision
            r, end[own], reserved = _residuals(bits, a, block, order)
            bad[own] |= reserved
            if order == 0:
                x[own] = r
            else:
                y = np.empty((block, len(own)), np.int64)
                y[:order] = warm.T
                c = np.ascontiguousarray(coefs.T)
                for t in range(order, block):
                    s = c[0] * y[t - 1]
                    for j in range(1, order):
                        s += c[j] * y[t - 1 - j]
                    y[t] = r[:, t - order] + (s >> shift)
                x[own] = y.T
        x[own] <<= lost
    return x, end, bad


def _headers(data: np.ndarray, begin: int, end: int, most: int, bps: int) -> list[tuple[int, int, int, int]]:
    """(start, number, body, samples) of every place in a stream that reads as a frame header with a valid CRC-8 and fits its stream."""
    d = data[begin:end]
    at = np.flatnonzero((d[:-5] == 0xFF) & (d[1:-4] == 0xF8)) if len(d) > 5 else np.zeros(0, np.int64)
    found = []
    for s in at.tolist():
        h = d[s : s + 16].tobytes()
        lead = h[4]
        n = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
        if n != 1 and not 2 <= n <= 7:
            continue
        number = lead if n == 1 else lead & (0x7F >> n)
        for b in h[5 : 4 + n]:
            number = number << 6 | (b & 0x3F)
        code = h[2] >> 4
        wide = {6: 1, 7: 2}.get(code, 0)
        size = 4 + n + wide + {12: 1, 13: 2, 14: 2}.get(h[2] & 15, 0)
        if len(h) <= size or h[3] >> 4 or BITS.get(h[3] >> 1 & 7, bps) != bps:
            continue
        samples = int.from_bytes(h[4 + n : 4 + n + wide], "big") + 1 if wide else SIZES.get(code, 0)
        if not 0 < samples <= most:
            continue
        c = 0
        for b in h[:size]:
            c = int(_CRC8[c ^ b])
        if c == h[size]:
            found.append((begin + s, number, begin + s + size + 1, samples))
    return found


def _decoded(data: np.ndarray, start: np.ndarray, body: np.ndarray, samples: np.ndarray, bps: np.ndarray, limit: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Samples, end and soundness (no reserved code, CRC-16 closes) of the frames that may begin at ``start``, window by window.

    A frame of more than 8 bytes a sample, beyond what any encoder writes, counts as damaged.
    """
    n = len(start)
    blocks: list = [None] * n
    ends, sound = np.zeros(n, np.int64), np.zeros(n, bool)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(start, start[i] + SLICE)))
        low, high = int(start[i]), min(len(data), int(start[j - 1]) + 64 + 8 * int(samples[i:j].max()))
        part = data[low:high]
        bits = _Bits(part)
        for size, width in {(int(a), int(b)) for a, b in zip(samples[i:j], bps[i:j])}:
            own = i + np.flatnonzero((samples[i:j] == size) & (bps[i:j] == width))
            x, end, bad = _subframes(bits, (body[own] - low) * 8, size, width)
            stop = (end + 7) // 8 + 2
            fits = ~bad & (stop <= np.minimum(high, limit[own]) - low)
            whole = np.zeros(len(own), bool)
            whole[fits] = _crc(part, start[own[fits]] - low, stop[fits], True) == 0  # a range with its own CRC at the end has CRC 0
            ends[own], sound[own] = stop + low, whole
            for f, row in zip(own.tolist(), x.astype(np.int32)):
                blocks[f] = row
        i = j
    return blocks, ends, sound


class Stream:
    """One decoded stream: its samples, the first sample of each block, and whether each block's and the whole's checksum hold."""

    def __init__(self, rate: int, bps: int, samples: np.ndarray, offsets: np.ndarray, block_ok: np.ndarray, md5_ok: bool):
        self.rate, self.bps, self.samples, self.offsets, self.block_ok, self.md5_ok = rate, bps, samples, offsets, block_ok, md5_ok


def _info(m: bytes) -> tuple[int, int, int, int, bytes, int] | None:
    """Rate, bits, samples, samples to a block, MD5 and the first frame's place; None for what isn't a mono FLAC stream."""
    if m[:4] != b"fLaC" or len(m) < 42 or m[4] & 0x7F:
        return None
    packed = int.from_bytes(m[18:26], "big")
    rate, channels, bps, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    if channels != 1 or bps > 24:
        return None
    at = 4
    while at + 4 <= len(m):
        last, size = m[at] >> 7, int.from_bytes(m[at + 1 : at + 4], "big")
        at += 4 + size
        if last:
            return rate, bps, total, struct.unpack(">H", m[10:12])[0], m[26:42], at
    return None


def decode(media: list[bytes]) -> list[Stream | None]:
    """Decodes many streams side by side; None for what isn't FLAC or isn't mono of up to 24 bits.

    A frame whose CRC-16 fails is decoded as far as its bits go and flagged. Behind it the walk goes on at the next header
    of the next number, or of a later one whose frame is sound; frames passed over are flagged blocks of zeros, so that
    one bad block leaves the others whole and in their places.
    """
    data = np.frombuffer(b"".join(media), np.uint8)
    infos = [_info(m) for m in media]
    rows, owner, base, begins = [], [], 0, []
    for i, (m, info) in enumerate(zip(media, infos)):
        begins.append(base)
        if info:
            own = _headers(data, base + info[5], base + len(m), info[3], info[1])
            rows += own
            owner += [i] * len(own)
        base += len(m)
    start, number, body, samples = (np.array(c, np.int64) for c in (zip(*rows) if rows else ((),) * 4))
    limit = np.array([begins[i] + len(media[i]) for i in owner], np.int64)
    blocks, ends, sound = _decoded(data, start, body, samples, np.array([infos[i][1] for i in owner], np.int64), limit)
    bounds = np.searchsorted(owner, np.arange(len(media) + 1))
    out: list[Stream | None] = []
    for i, info in enumerate(infos):
        if info is None:
            out.append(None)
            continue
        rate, bps, total, block, md5, first = info
        a, b = int(bounds[i]), int(bounds[i + 1])
        place = {int(s): a + j for j, s in enumerate(start[a:b])}
        at, n, taken, ok = begins[i] + first, 0, [], []
        stop = begins[i] + len(media[i])
        while at < stop:
            f = place.get(at)
            if f is None or number[f] != n:  # damage: the next header in order, or a sound frame further on
                after = range(int(np.searchsorted(start[a:b], at)) + a, b)
                f = next((j for j in after if number[j] == n or number[j] > n and sound[j]), None)
                if f is None:
                    break
            for _ in range(n, min(int(number[f]), n + (stop - at))):  # a frame takes a byte at least
                taken.append(np.zeros(block, np.int32))
                ok.append(False)
            taken.append(blocks[f])
            ok.append(bool(sound[f]))
            n = int(number[f]) + 1
            at = int(ends[f]) if sound[f] else int(start[f]) + 1
        x = np.concatenate(taken) if taken else np.zeros(0, np.int32)
        sizes = np.array([len(t) for t in taken], np.int64)
        check = hashlib.md5()
        for j in range(0, len(x), SLICE):
            check.update(_bytes(x[j : j + SLICE], bps))
        good = (len(x) == total or not total) and (md5 == bytes(16) or check.digest() == md5)
        out.append(Stream(rate, bps, x, np.cumsum(sizes) - sizes, np.array(ok, bool), good))
    return out


def _bytes(x: np.ndarray, bps: int) -> bytes:
    """Samples as little-endian signed integers of whole bytes."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : -(-bps // 8)]).tobytes()


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8, padded with spaces to a positive multiple of BLOCK bytes, as a FLAC stream.

    Null and empty texts are one block of spaces. Equal texts give equal streams; rows repeat as they come.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            for i, j in slices(off, SLICE):
                texts = [raw[a:b].tobytes() for a, b in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist())]
                media = encode([t.ljust(max(1, -(-len(t) // BLOCK)) * BLOCK, b" ") for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    chosen = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return chosen.mapInArrow(write, "doc_id bigint, n_bytes bigint, media binary")


#: The new columns of a decoded table.
PCM = {"rate": "int", "bits": "int", "pcm": "binary", "blocks": "array<struct<sample_offset:bigint,n_samples:int,crc_ok:boolean>>", "md5_ok": "boolean", "feature": "string", "valid": "boolean"}


def read(rows: DataFrame, media: str = "media") -> DataFrame:
    """All columns of ``rows`` plus rate, bits, pcm, blocks, md5_ok, feature and valid, decoded from the binary column ``media``.

    pcm holds 8-bit samples as unsigned bytes (sample + 128), wider ones as little-endian signed integers. blocks has the
    first sample and length of each frame, in order, and whether its checksum holds. feature is made of whole numbers:
    samples, sum, sum of squares, sign changes and peak. What isn't FLAC, or isn't supported, has valid false and nulls
    in the other new columns; a null has nulls in all. Long streams are decoded window by window. Rows repeat as they
    come; an empty table gives no rows. Columns of ``rows`` by the new names are replaced, all others stay.
    """
    given = Columns(rows, PCM)
    chosen = small_batches(given.rows).select(*given.kept())
    at = chosen.columns.index(given.at(media))
    names = [*chosen.columns, *PCM]

    def one(s: Stream | None) -> dict:
        if s is None:
            return {"valid": False}
        n, total, square, flips, peak, before = len(s.samples), 0, 0, 0, 0, None
        pcm = []
        for j in range(0, n, SLICE):
            x = s.samples[j : j + SLICE].astype(np.int64)
            pcm.append((x + 128).astype(np.uint8).tobytes() if s.bps == 8 else _bytes(x, s.bps))
            below = x < 0
            flips += int(np.count_nonzero(below[1:] != below[:-1])) + int(before is not None and before != below[0])
            total, square, peak, before = total + int(x.sum()), square + int((x * x).sum()), max(peak, int(np.abs(x).max())), below[-1]
        feature = f"n={n};sum={total};sq={square};flips={flips};peak={peak}"
        sizes = np.diff(np.append(s.offsets, n))
        blocks = [{"sample_offset": o, "n_samples": z, "crc_ok": bool(k)} for o, z, k in zip(s.offsets.tolist(), sizes.tolist(), s.block_ok)]
        return {"rate": s.rate, "bits": s.bps, "pcm": b"".join(pcm), "blocks": blocks, "md5_ok": bool(s.md5_ok), "feature": feature, "valid": True}

    kind = pa.struct([("rate", pa.int32()), ("bits", pa.int32()), ("pcm", pa.binary()), ("blocks", pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("crc_ok", pa.bool_())]))), ("md5_ok", pa.bool_()), ("feature", pa.string()), ("valid", pa.bool_())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(column).to_pylist()], np.int64)
            for i, j in slices(np.concatenate([[0], np.cumsum(sizes)]), SLICE):
                part = batch.slice(i, j - i)
                values = part.column(at).to_pylist()
                found = iter(decode([v for v in values if v is not None]))
                made = pa.array([None if v is None else one(next(found)) for v in values], kind)
                yield pa.RecordBatch.from_arrays([*part.columns, *made.flatten()], names)

    import pyarrow.compute  # noqa: F401

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema] + [f"{k} {v}" for k, v in PCM.items()])
    return given.named(chosen.mapInArrow(parse, schema), *PCM)


def blocks(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sample_offset, n_samples, crc_ok, pcm): one row per block, for writing a table that is sought by sample offset."""
    wide = F.ceil(F.col("bits") / 8).cast("long")
    rows = decoded.select(key, "bits", "pcm", F.explode("blocks").alias("b"))
    part = F.substring("pcm", (F.col("b.sample_offset") * wide + 1).cast("int"), (F.col("b.n_samples") * wide).cast("int"))
    return rows.select(key, "b.sample_offset", "b.n_samples", "b.crc_ok", part.alias("pcm"))
