"""Media columns: FLAC, written and read back in numpy.

Every text becomes a lossless mono FLAC stream of 8-bit samples: its UTF-8 bytes, filled
up with bytes 255 to a positive multiple of 576, one frame for each 576 samples.  Frames
are coded as constant, verbatim, fixed or linear predictors (fitted to each frame) with
partitioned Rice residuals, whichever is shortest, each with its CRC-8 and CRC-16; a seek
table names every frame's first sample and offset.  The format has room for 932,067 of them;
a longer stream names every second, third.. frame, and the others are found from there.

The decoder takes frames of any block size and predictor order (mono; several channels are
refused), verifies both checksums of every frame and the stream's MD5, and yields PCM
blocks with their sample offsets: :func:`pcm_blocks` makes them the rows of a table, and
:func:`read_samples` reads from any sample on without decoding what is before.  Frames are decoded side by side, one array step for the
n-th residual of all of them, so no Python loop runs over samples.

Memory is bounded by ``SLICE`` bytes of text (or one text, if longer).  Nulls: a null text
counts as empty and gives one frame of filling; a null id is carried through.  Equal texts
give equal rows.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, utf8

BLOCK = 576
PARTITION_ORDER = 2
SLICE = 4 << 20
RATE = 8000
ORDER, SHIFT = 4, 10  # of the fitted predictors
# Fixed values of the format: block sizes and sample widths by their codes, fixed predictors by order.
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
POLY8, POLY16 = 0x07, 0x8005


class FlacError(ValueError):
    """The stream breaks the format, or a checksum."""


@cache
def _table16() -> np.ndarray:
    """CRC-16 of every two-byte word."""
    t = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        t = np.where(t & 0x8000, (t << 1) ^ POLY16, t << 1) & 0xFFFF
    return t.astype(np.uint16)


@cache
def _zeros16() -> np.ndarray:
    """Leading zeros of every 16-bit number."""
    return np.array([16 - n.bit_length() for n in range(1 << 16)], dtype=np.uint8)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c << 1 ^ POLY8 if c & 0x80 else c << 1) & 0xFF
    return c


def crc16_rows(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of each of several byte strings that follow one another in ``flat``.

    The strings are right-aligned: zeros in front leave a CRC that starts at zero alone.
    """
    wide = int(lengths.max(initial=0))
    wide += wide & 1
    rows = np.zeros((len(lengths), wide), dtype=np.uint8)
    rows[np.arange(wide) >= wide - lengths[:, None]] = flat
    pairs = np.ascontiguousarray(rows.view(">u2").T).astype(np.uint16)
    table, c = _table16(), np.zeros(len(lengths), dtype=np.uint16)
    for p in pairs:
        c = table[c ^ p]
    return c


@lru_cache(maxsize=1 << 16)
def _header(number: int) -> bytes:
    """A frame's header: fixed block size of 576, 8 kHz, mono, 8 bits, the frame's number, CRC-8."""
    if number < 0x80:
        coded = bytes([number])
    else:
        k = next(k for k in range(2, 8) if number < 1 << (5 * k + 1))
        coded = bytes([(0xFF00 >> k) & 0xFF | number >> 6 * (k - 1), *(0x80 | number >> 6 * j & 0x3F for j in range(k - 2, -1, -1))])
    head = b"\xff\xf8" + bytes([0x24, 0x02]) + coded
    return head + bytes([crc8(head)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return ((r << 1) ^ (r >> 31)).astype(np.uint32)


def _rice(u: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The best parameter for each frame's partitions, and the frame's bits; ``first`` are warm-up samples."""
    parts = 1 << PARTITION_ORDER
    n = BLOCK // parts
    u = u.copy()
    u[:, :first] = 0
    split = u.reshape(len(u), parts, n)
    counts = np.full(parts, n)
    counts[0] -= first
    cost = np.stack([(split >> k).sum(axis=2, dtype=np.int64) + counts * (1 + k) for k in range(13)])
    return cost.argmin(axis=0), cost.min(axis=0).sum(axis=1) + 8 * first + 4 * parts + 6


def fitted(samples: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Each frame's linear predictor: from its autocorrelation by Levinson's recursion, in 1024ths."""
    x = samples.astype(np.float64)
    r = [(x[:, k:] * x[:, : BLOCK - k]).sum(axis=1) for k in range(order + 1)]
    error = r[0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), order))
    for i in range(order):
        k = (r[i + 1] - sum(a[:, j] * r[i - j] for j in range(i))) / error
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a, error = new, np.maximum(error * (1 - k * k), 1e-9)
    return list(np.clip(np.rint(a * (1 << SHIFT)), -(1 << 14), (1 << 14) - 1).astype(np.int32).T)


def _predict(samples: np.ndarray, coefs: list, shift: int) -> np.ndarray:
    """Residuals of frames (rows) under a predictor (numbers, or one for each frame); the first samples are left as they are."""
    r = samples.copy()
    order = len(coefs)
    if order:
        guess = sum((c[:, None] if np.ndim(c) else c) * samples[:, order - 1 - j : BLOCK - 1 - j] for j, c in enumerate(coefs))
        r[:, order:] -= guess >> shift
    return r


def _pack_fields(values: np.ndarray, widths: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of fields (at most 17 bits each, after ``gaps`` zero bits) as rows of bytes, and their lengths."""
    ends = np.cumsum(widths + gaps, axis=1, dtype=np.int64)
    lengths = (ends[:, -1] + 7) // 8
    stride = int(lengths.max()) + 3
    last = ends - 1 + 16 + (np.arange(len(values)) * stride * 8)[:, None]
    field = (values.astype(np.int64) << (7 - (last & 7))).ravel()
    place = (last >> 3).ravel()
    out = np.zeros(stride * len(values) + 2)
    for k in range(3):
        out += np.bincount(place - k, weights=(field >> (8 * k)) & 0xFF, minlength=len(out))
    return out[2:].astype(np.uint8).reshape(len(values), stride), lengths


def _bodies(samples: np.ndarray, predictor: tuple[list[int], int] | None) -> list[bytes]:
    """The subframe of each row of 576 samples, by the cheapest coding."""
    n = len(samples)
    codings: list[tuple] = [(8 + order, FIXED[order], 0) for order in range(5)]
    codings.append((31 + ORDER, fitted(samples), SHIFT))
    if predictor:
        codings.append((31 + len(predictor[0]), *predictor))
    residuals = [_zigzag(_predict(samples, c, s)) for _, c, s in codings]
    choices = [_rice(u, len(c)) for u, (_, c, _) in zip(residuals, codings, strict=True)]
    bits = np.stack([b + (9 + 15 * len(c) if t >= 32 else 0) for (_, b), (t, c, _) in zip(choices, codings, strict=True)])
    best = bits.argmin(axis=0)
    constant = (samples == samples[:, :1]).all(axis=1)
    verbatim = ~constant & (bits.min(axis=0) >= 8 * BLOCK)
    out: list[bytes] = [b""] * n
    for i in np.flatnonzero(constant).tolist():
        out[i] = bytes([0, int(samples[i, 0]) & 0xFF])
    for i in np.flatnonzero(verbatim).tolist():
        out[i] = b"\x02" + (samples[i] & 0xFF).astype(np.uint8).tobytes()
    parts = 1 << PARTITION_ORDER
    size = BLOCK // parts
    for which, (kind, coefs, shift) in enumerate(codings):
        rows = np.flatnonzero((best == which) & ~constant & ~verbatim)
        if not len(rows):
            continue
        order, m = len(coefs), len(rows)
        u, k = residuals[which][rows], choices[which][0][rows]
        head = [(kind << 1, 8)]
        after = [(14, 4), (shift & 31, 5), *(((c[rows] if np.ndim(c) else c) & 0x7FFF, 15) for c in coefs)] if kind >= 32 else []
        after.append((PARTITION_ORDER, 6))
        values, widths, gaps = [], [], []

        def put(v, w, g=0, into=(values, widths, gaps), rows=m):
            for column, x in zip(into, (v, w, g), strict=True):
                column.append(np.broadcast_to(np.asarray(x, dtype=np.int64).reshape(-1, 1) if np.ndim(x) < 2 else x, (rows, np.shape(v)[1] if np.ndim(v) == 2 else 1)))

        for v, w in head:
            put(v, w)
        if order:
            put(samples[rows, :order] & 0xFF, 8)
        for v, w in after:
            put(v, w)
        for p in range(parts):
            kp = k[:, p : p + 1].astype(np.int64)
            put(k[:, p], 4)
            up = u[:, max(p * size, order) : (p + 1) * size].astype(np.int64)
            put((1 << kp) | (up & ((1 << kp) - 1)), np.broadcast_to(kp + 1, up.shape), up >> kp)
        packed, lengths = _pack_fields(*(np.concatenate(x, axis=1) for x in (values, widths, gaps)))
        for i, row, length in zip(rows.tolist(), packed, lengths.tolist(), strict=True):
            out[i] = row[:length].tobytes()
    return out


def encode(payloads: list[bytes], predictor: tuple[list[int], int] | None = None) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of 576.

    ``predictor`` (coefficients of 15 bits and a shift) is tried besides the fixed and fitted ones.
    """
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    samples = flat.reshape(-1, BLOCK).astype(np.int32) - 128
    counts = [len(p) // BLOCK for p in payloads]
    bodies = _bodies(samples, predictor) if len(samples) else []
    frames = [_header(i) + body for i, body in zip((i for c in counts for i in range(c)), bodies, strict=True)]
    lengths = np.array([len(f) for f in frames], dtype=np.int64)
    checks = crc16_rows(np.frombuffer(b"".join(frames), np.uint8), lengths)
    frames = [f + int(c).to_bytes(2, "big") for f, c in zip(frames, checks.tolist(), strict=True)]
    out, at = [], 0
    signed = (flat ^ 0x80).tobytes()
    for p, count in zip(payloads, counts, strict=True):
        own = frames[at : at + count]
        sizes = list(map(len, own))
        seek, offset = [], 0
        for i, s in enumerate(sizes):
            seek.append(struct.pack(">QQH", i * BLOCK, offset, BLOCK))
            offset += s
        bits = RATE << 44 | 0 << 41 | 7 << 36 | len(p)
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + bits.to_bytes(8, "big") + hashlib.md5(signed[at * BLOCK : at * BLOCK + len(p)], usedforsecurity=False).digest()
        # a metadata block holds less than 2^24 bytes: further tables would be ignored, so the table is thinned then
        step = -(-len(seek) * 18 // ((1 << 24) - 18)) or 1
        table = b"".join(seek[::step])
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
        at += count
    return out


class _Bits:
    """Big-endian bit fields at many places of one buffer."""

    def __init__(self, data: bytes) -> None:
        self.raw = np.frombuffer(data + bytes(16), np.uint8)
        self.words = np.ndarray((len(self.raw) - 7,), dtype=">u8", buffer=self.raw, strides=(1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """The 57 bits (at least) from each bit position on, at the top of a word."""
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, bits: int | np.ndarray) -> np.ndarray:
        return ((self.window(at) >> np.uint64(1)) >> (63 - np.asarray(bits)).astype(np.uint64)).astype(np.int64)

    def signed(self, at: np.ndarray, bits: int) -> np.ndarray:
        v = self.take(at, bits)
        return v - ((v >> (bits - 1)) << bits)


def _residuals(bits: _Bits, at: np.ndarray, order: int, block: int, out: np.ndarray) -> np.ndarray:
    """Fills rows ``order``.. of ``out`` (one column a frame) and returns the positions after them."""
    heads = bits.take(at, 6)
    if len(kinds := np.unique(heads)) > 1:
        ends = np.empty_like(at)
        for k in kinds.tolist():
            those = np.flatnonzero(heads == k)
            part = np.empty((block, len(those)), dtype=np.int64)
            ends[those] = _residuals(bits, at[those], order, block, part)
            out[order:, those] = part[order:]
        return ends
    method, parts = int(heads[0]) >> 4, 1 << (int(heads[0]) & 15)
    if method > 1 or block % parts or block // parts < order:
        raise FlacError("residual coding")
    width = 4 + method
    at = at + 6
    zeros, one = _zeros16(), np.uint64(1)
    row = order
    for p in range(parts):
        k = bits.take(at, width)
        at = at + width
        count = block // parts - (order if p == 0 else 0)
        raw = k == (1 << width) - 1
        if raw.any():
            lanes = np.flatnonzero(raw)
            size = bits.take(at[lanes], 5)
            here = at[lanes] + 5
            for i in range(count):
                v = bits.take(here, size)
                out[row + i, lanes] = v - ((v >> np.maximum(size - 1, 0) & (size > 0)) << size)
                here = here + size
            at[lanes] = here
        lanes = np.flatnonzero(~raw)
        if len(lanes):
            pos, kk = at[lanes], k[lanes]
            after = (63 - kk).astype(np.uint64)
            for i in range(count):
                w = bits.window(pos)
                q = zeros[(w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
                low = ((w << (q + 1).astype(np.uint64)) >> one) >> after
                if (far := np.flatnonzero(q == 16)).size:
                    for j in far.tolist():
                        start = int(pos[j])
                        while not (hit := int(bits.take(np.array([start]), 32)[0])):
                            start += 32
                            if start > 8 * len(bits.raw) - 128:
                                raise FlacError("unary run beyond the data")
                        start += 32 - hit.bit_length()
                        q[j] = start - pos[j]
                        low[j] = np.uint64(int(bits.take(np.array([start + 1]), int(kk[j]))[0]))
                u = (q << kk) | low.astype(np.int64)
                out[row + i, lanes] = (u >> 1) ^ -(u & 1)
                pos = pos + q + 1 + kk
            at[lanes] = pos
        row += count
    return at


def _subframes(bits: _Bits, at: np.ndarray, block: int, width: int, out: np.ndarray) -> np.ndarray:
    """Samples of frames of one block size into the columns of ``out``; the positions after them."""
    heads = bits.take(at, 8)
    ends = np.empty_like(at)
    for head in np.unique(heads).tolist():
        those = np.flatnonzero(heads == head)
        kind, pos = head >> 1, at[those] + 8
        if head & 0x81:
            raise FlacError("subframe header (wasted bits are not supported)")
        part = np.empty((block, len(those)), dtype=np.int64)
        if kind == 0:
            part[:] = bits.signed(pos, width)
            pos = pos + width
        elif kind == 1:
            for i in range(block):
                part[i] = bits.signed(pos + i * width, width)
            pos = pos + block * width
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            for i in range(order):
                part[i] = bits.signed(pos + i * width, width)
            pos = pos + order * width
            shift = np.zeros(len(those), dtype=np.int64)
            coefs = [np.full(len(those), c, dtype=np.int64) for c in FIXED.get(order, [])] if kind < 32 else []
            if kind >= 32:
                precision = bits.take(pos, 4) + 1
                shift = bits.signed(pos + 4, 5)
                if (precision == 16).any() or (shift < 0).any():
                    raise FlacError("predictor")
                pos = pos + 9
                for _ in range(order):
                    v = bits.take(pos, precision)
                    coefs.append(v - ((v >> (precision - 1)) << precision))
                    pos = pos + precision
            pos = _residuals(bits, pos, order, block, part)
            if order:
                for i in range(order, block):
                    guess = coefs[0] * part[i - 1]
                    for j in range(1, order):
                        guess = guess + coefs[j] * part[i - 1 - j]
                    part[i] += guess >> shift
        else:
            raise FlacError("reserved subframe")
        out[:, those] = part
        ends[those] = pos
    return ends


def _frame_head(data: bytes, at: int, default_width: int) -> tuple[int, int, int]:
    """(block size, sample width, header length) of the frame at ``at``; its CRC-8 must hold."""
    if data[at : at + 2] not in (b"\xff\xf8", b"\xff\xf9"):
        raise FlacError("no frame here")
    sizes, rates = data[at + 2] >> 4, data[at + 2] & 15
    channels, widths = data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if channels:
        raise FlacError("only mono is supported")
    lead = data[at + 4]
    n = at + 4 + max(1, 8 - (lead ^ 0xFF).bit_length())
    block = BLOCK_SIZES.get(sizes, 0)
    if sizes in (6, 7):
        block = int.from_bytes(data[n : n + sizes - 5], "big") + 1
        n += sizes - 5
    n += {12: 1, 13: 2, 14: 2}.get(rates, 0)
    if not block or crc8(data[at:n]) != data[n]:
        raise FlacError("frame header checksum")
    return block, WIDTHS.get(widths, default_width), n + 1 - at


_heads: dict[bytes, tuple[int, int, int]] = {}


def _known_head(data: bytes, at: int, width: int) -> tuple[int, int, int]:
    """As :func:`_frame_head`; headers that were checked before are looked up by their bytes."""
    for n in (6, 7, 8):
        if got := _heads.get(data[at : at + n]):
            return got
    got = _frame_head(data, at, width)
    if len(_heads) < 1 << 16:
        _heads[data[at : at + got[2]]] = got
    return got


def _decode_at(data: bytes, starts: list[int], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples and ends of the frames at ``starts``; their CRC-16 must hold."""
    heads = [_known_head(data, s, width) for s in starts]
    bits = _Bits(data)
    samples: list = [None] * len(starts)
    ends = np.zeros(len(starts), dtype=np.int64)
    for key in set((h[0], h[1]) for h in heads):
        those = np.array([i for i, h in enumerate(heads) if (h[0], h[1]) == key])
        at = np.array([8 * (starts[i] + heads[i][2]) for i in those.tolist()], dtype=np.int64)
        part = np.empty((key[0], len(those)), dtype=np.int64)
        ends[those] = (_subframes(bits, at, key[0], key[1], part) + 7) >> 3
        rows = np.ascontiguousarray(part.T)
        for i, r in zip(those.tolist(), rows, strict=True):
            samples[i] = r
    if (ends + 2 > len(data)).any():
        raise FlacError("frame beyond the data")
    lengths = ends - np.array(starts)
    flat = np.frombuffer(b"".join(data[s:e] for s, e in zip(starts, ends.tolist(), strict=True)), np.uint8)
    stored = np.array([int.from_bytes(data[e : e + 2], "big") for e in ends.tolist()], dtype=np.uint16)
    if (crc16_rows(flat, lengths) != stored).any():
        raise FlacError("frame checksum")
    return samples, ends + 2


def _metadata(data: bytes) -> tuple[int, int, bytes, list[tuple[int, int]], int]:
    """(sample width, samples, MD5, seek points (sample, offset), where the frames begin)."""
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, width, total, digest, seek = 4, 0, 0, b"", []
    while True:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            bits = int.from_bytes(body[10:18], "big")
            width, total, digest = (bits >> 36 & 31) + 1, bits & (1 << 36) - 1, body[18:34]
        elif kind & 0x7F == 3:
            seek = [(s, o) for s, o, _ in struct.iter_unpack(">QQH", body) if s != (1 << 64) - 1]
        at += 4 + size
        if kind & 0x80:
            return width, total, digest, seek, at


def decode(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """The PCM blocks of each stream as (first sample, samples).

    The seek points of all streams are decoded at once; frames between them follow in
    further rounds.  Every frame's checksums and every stream's MD5 must hold.
    """
    data = b"".join(streams)
    base, heads, lanes = 0, [], []
    for i, s in enumerate(streams):
        width, total, digest, seek, begin = _metadata(s)
        heads.append((width, total, digest))
        seek = sorted(set(seek) | {(0, 0)})
        for (first, offset), nxt in zip(seek, [*(x for x, _ in seek[1:]), total], strict=True):
            if first < total:
                lanes.append((i, first, base + begin + offset, nxt))
        base += len(s)
    blocks: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    while lanes:
        rest = []
        for width in {heads[x[0]][0] for x in lanes}:
            own = [x for x in lanes if heads[x[0]][0] == width]
            samples, ends = _decode_at(data, [x[2] for x in own], width)
            for (i, first, _, until), s, end in zip(own, samples, ends.tolist(), strict=True):
                blocks[i].append((first, s))
                if first + len(s) < until:
                    rest.append((i, first + len(s), end, until))
        lanes = rest
    for b, (width, total, digest) in zip(blocks, heads, strict=True):
        b.sort(key=lambda x: x[0])
        if sum(len(s) for _, s in b) != total:
            raise FlacError("sample count")
        kind = "<i1" if width <= 8 else "<i2" if width <= 16 else "<i4"
        if any(digest) and width in (8, 16) and hashlib.md5(np.concatenate([s for _, s in b]).astype(kind).tobytes(), usedforsecurity=False).digest() != digest:
            raise FlacError("MD5 of the samples")
    return blocks


def read_samples(stream: bytes, first: int, count: int) -> np.ndarray:
    """``count`` samples from ``first`` on: decoding begins at the seek point before them.

    The frames that are read must have right checksums; samples beyond the end are left out.
    """
    width, total, _, seek, begin = _metadata(stream)
    until = min(first + count, total)
    if first >= until:
        return np.zeros(0, np.int64)
    at, offset = max((p for p in [(0, 0), *seek] if p[0] <= first), key=lambda p: p[0])
    place, found, start = begin + offset, [], at
    while at < until:
        samples, ends = _decode_at(stream, [place], width)
        found.append(samples[0])
        at, place = at + len(samples[0]), int(ends[0])
    return np.concatenate(found)[first - start : until - start]


BLOCKS = "first_sample bigint, n_samples bigint, pcm binary"


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, first_sample, n_samples, pcm): a row for each frame of each row's stream.

    ``pcm`` holds signed little-endian samples of 1, 2 or 4 bytes.  A null stream has no rows.
    """

    def run(batches):
        for batch in batches:
            for b in batches_of(batch, "media", SLICE):
                keep = [(i, m) for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if m is not None]
                for (i, m), blocks in zip(keep, decode([m for _, m in keep]), strict=True):
                    width = _metadata(m)[0]
                    kind = "<i1" if width <= 8 else "<i2" if width <= 16 else "<i4"
                    for at in range(0, len(blocks), 4096):
                        part = blocks[at : at + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.int64()), pa.array([f for f, _ in part], pa.int64()), pa.array([len(x) for _, x in part], pa.int64()), pa.array([x.astype(kind).tobytes() for _, x in part], pa.binary())], ["doc_id", "first_sample", "n_samples", "pcm"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, f"doc_id bigint, {BLOCKS}")


def payload(blob: bytes | None) -> bytes:
    """The bytes that are stored for a text: filled up with 255 to a positive multiple of 576."""
    raw = blob or b""
    return raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def features(samples: np.ndarray) -> str:
    """Integer features of PCM samples: peak, mean square, zero crossings, mean absolute step."""
    s = samples.astype(np.int64)
    n = len(s)
    crossings = int(((s[1:] < 0) != (s[:-1] < 0)).sum())
    return f"peak={int(np.abs(s).max())};power={int((s * s).sum()) // n};crossings={crossings};step={int(np.abs(np.diff(s)).sum()) // n}"


def store_as_flac(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Per row the digests of the stored stream and of what is read back from it; ``with_media`` adds the stream."""

    def run(batches):
        for batch in batches:
            for b in batches_of(batch, "text", SLICE):
                texts = b.column(1).to_pylist()
                media = encode([payload(t) for t in texts])
                rows = []
                for i, t, stream, blocks in zip(b.column(0).to_pylist(), texts, media, decode(media), strict=True):
                    pcm = np.concatenate([s for _, s in blocks])
                    back = (pcm + 128).astype(np.uint8).tobytes()
                    rows.append((i, len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), features(pcm), *[stream] * with_media))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * with_media]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_media]
    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary" * with_media
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, schema)
