"""Media columns in FLAC: encode payloads as 8-bit samples, decode them with verified checksums.

The encoder picks per frame a constant, verbatim, fixed or linear-predictor subframe and Rice-codes
the residual in partitions. The decoder reads Rice residuals of thousands of frames in step: each
frame is a lane with its own bit position, and one numpy operation advances all lanes by a sample.
Frames that lanes do not cover (several channels, escaped partitions, wasted bits, other sample
sizes) take a plain bit reader. A seek table with a point per frame gives PCM blocks by sample
offset without decoding what is before them.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_texts, written

NAME = "op3_flac_media"
ORACLE_SQL = None  # the format is not expressible in SQL; tests use exact round trips

#: Samples of a frame; the last frame of a stream may be shorter.
BLOCK = 576
#: Payloads are filled up with spaces to a positive multiple of this.
PAYLOAD_UNIT = 192
RATE_HZ = 8000
#: Order and coefficient precision of the linear predictor, and log2 of the partitions of a frame.
LPC_ORDER, LPC_BITS, PARTITION_ORDER = 8, 10, 2
#: Frames that are coded in step.
LANES = 1024
#: Coefficients of the fixed predictors by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """A stream breaks the format or a checksum."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    v = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        v = np.where(v >> (bits - 1) & 1, v << 1 ^ poly, v << 1) & ((1 << bits) - 1)
    return v


@functools.cache
def _crc8_table() -> list[int]:
    return _crc_table(0x07, 8).tolist()


@functools.cache
def _crc16_pairs() -> np.ndarray:
    """CRC-16 of every two bytes, so that a step takes 16 bits."""
    t = _crc_table(0x8005, 16)
    v = np.arange(65536, dtype=np.uint32)
    one = t[v >> 8]
    return (((one << 8) & 0xFFFF) ^ t[(one >> 8) ^ (v & 0xFF)]).astype(np.uint16)


def crc8(data: bytes) -> int:
    table, c = _crc8_table(), 0
    for b in data:
        c = table[c ^ b]
    return c


def crc16_many(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of a byte array; zeros before a stretch do not change it."""
    out = np.zeros(len(starts), np.uint16)
    table = _crc16_pairs()
    for at in range(0, len(starts), LANES):
        s, e = starts[at : at + LANES], ends[at : at + LANES]
        width = int((e - s).max(initial=0) + 1) // 2 * 2
        index = e[:, None] - width + np.arange(width)
        rows = np.where(index >= s[:, None], flat[np.maximum(index, 0)], 0).astype(np.uint16)
        words = np.ascontiguousarray((rows[:, 0::2] << 8 | rows[:, 1::2]).T)
        c = np.zeros(len(s), np.uint16)
        for w in words:
            c = table[c ^ w]
        out[at : at + LANES] = c
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's variable-length code."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([(0xFE << (6 - len(tail)) & 0xFF) | n, *reversed(tail)])


@functools.lru_cache(200_000)
def _frame_header(number: int, n: int) -> bytes:
    if n == 192:
        code, more = 1, b""
    elif n in (576, 1152, 2304, 4608):
        code, more = 2 + (576, 1152, 2304, 4608).index(n), b""
    elif n <= 256:
        code, more = 6, bytes([n - 1])
    else:
        code, more = 7, struct.pack(">H", n - 1)
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0 << 4 | 1 << 1]) + _number(number) + more
    return head + bytes([crc8(head)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _predict(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Predictions of x[:, order:] by quantised coefficients [frames, order]."""
    order = coefs.shape[1]
    total = np.zeros((x.shape[0], x.shape[1] - order), np.int64)
    for j in range(order):
        total += coefs[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
    return total >> shift[:, None]


def _linear_predictor(x: np.ndarray, order: int = LPC_ORDER, bits: int = LPC_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts by Levinson-Durbin.

    Autocorrelations are exact integers and the rest is elementwise, so that a frame's values do not
    depend on the frames beside it.
    """
    n = x.shape[1]
    wide = x.astype(np.int64)
    auto = np.stack([(wide[:, : n - k] * wide[:, k:]).sum(1) for k in range(order + 1)], 1).astype(np.float64)
    a = np.zeros((len(x), order))
    error = auto[:, 0] + 1e-9
    for i in range(order):
        acc = auto[:, i + 1].copy()
        for j in range(i):
            acc -= a[:, j] * auto[:, i - j]
        k = np.where(error > 1e-6, acc / np.maximum(error, 1e-6), 0.0)
        before = a.copy()
        a[:, i] = k
        for j in range(i):
            a[:, j] = before[:, j] - k * before[:, i - 1 - j]
        error = error * (1 - k * k)
    a = np.where(np.isfinite(a), a, 0.0)
    top = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(bits - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    limit = 1 << (bits - 1)
    return np.clip(np.rint(a * (2.0 ** shift)[:, None]), -limit, limit - 1).astype(np.int64), shift


def _rice(u: np.ndarray, order: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters [frames, parts] for zigzag residuals (zero at the warm-up), and an upper bound of the bits."""
    size = u.shape[1] // parts
    sums = u.reshape(len(u), parts, size).sum(2)
    count = np.full(parts, size)
    count[0] -= order
    ks = np.arange(15)
    cost = count[None, :, None] * (ks + 1) + (sums[:, :, None] >> ks)
    best = cost.argmin(2)
    return best, (np.take_along_axis(cost, best[:, :, None], 2)[:, :, 0] + 4).sum(1)


def _set_bits(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    """Write `width` bits of value, highest first, at column `at` of each row."""
    rows = np.arange(len(bits))
    for j in range(width):
        bits[rows, at + j] = value >> (width - 1 - j) & 1


def _emit(x: np.ndarray, kind: str, order: int, coefs: np.ndarray | None, shift: np.ndarray | None) -> list[bytes]:
    """Subframe bytes of frames that share kind and order."""
    g, n = x.shape
    unsigned = (x & 0xFF).astype(np.uint8)
    if kind == "constant":
        return [bytes([0, v]) for v in unsigned[:, 0].tolist()]
    if kind == "verbatim":
        return [b"\x02" + row.tobytes() for row in unsigned]
    parts = 1 << PARTITION_ORDER
    r = np.zeros((g, n), np.int64)
    if kind == "fixed":
        r[:, order:] = np.diff(x, order, axis=1) if order else x
        first, prefix = (8 | order) << 1, 8 + 8 * order + 6
    else:
        r[:, order:] = x[:, order:] - _predict(x, coefs, shift)
        first, prefix = (32 | order - 1) << 1, 8 + 8 * order + 9 + LPC_BITS * order + 6
    u = _zigzag(r)
    u[:, :order] = 0
    ks, _ = _rice(u, order, parts)
    size = n // parts
    k = np.repeat(ks, size, axis=1)
    length = (u >> k) + 1 + k
    length[:, :order] = 0
    length[:, ::size] += 4
    ends = prefix + length.cumsum(1)
    total = ends[:, -1]
    bits = np.zeros((g, int(total.max() + 7) // 8 * 8), np.uint8)
    at = np.zeros(g, np.int64)
    _set_bits(bits, at, np.full(g, first), 8)
    at += 8
    for j in range(order):
        _set_bits(bits, at, unsigned[:, j].astype(np.int64), 8)
        at += 8
    if kind == "lpc":
        _set_bits(bits, at, np.full(g, LPC_BITS - 1), 4)
        _set_bits(bits, at + 4, shift, 5)
        at += 9
        for j in range(order):
            _set_bits(bits, at, coefs[:, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
            at += LPC_BITS
    _set_bits(bits, at, np.full(g, PARTITION_ORDER), 6)  # method 0, then the partition order
    starts = ends - length
    for p in range(parts):
        _set_bits(bits, starts[:, p * size], ks[:, p], 4)
    flat = bits.reshape(-1)
    base = (np.arange(g) * bits.shape[1])[:, None] + ends - k - 1
    base, u, k = base[:, order:].ravel(), u[:, order:].ravel(), k[:, order:].ravel()
    flat[base] = 1
    for j in range(int(k.max(initial=0))):  # bit j of the low part
        use = k > j
        b = base[use] + k[use] - j
        flat[b] = u[use] >> j & 1
    packed = np.packbits(bits, axis=1)
    return [row[:m].tobytes() for row, m in zip(packed, ((total + 7) // 8).tolist(), strict=True)]


def _encode_frames(x: np.ndarray) -> list[bytes]:
    """Subframes of frames [g, n] of 8-bit samples."""
    g, n = x.shape
    parts = 1 << PARTITION_ORDER
    if n % parts or n // parts <= LPC_ORDER:
        return _emit(x, "verbatim", 0, None, None)
    sums = np.stack([np.abs(np.diff(x, o, axis=1) if o else x)[:, 4 - o :].sum(1) for o in range(5)], 1)
    fixed = sums.argmin(1)
    coefs, shift = _linear_predictor(x)
    cost = np.empty((g, 2), np.int64)
    for o in range(5):
        use = fixed == o
        if use.any():
            u = np.zeros((int(use.sum()), n), np.int64)
            u[:, o:] = _zigzag(np.diff(x[use], o, axis=1) if o else x[use])
            cost[use, 0] = 8 * o + _rice(u, o, parts)[1]
    u = np.zeros((g, n), np.int64)
    u[:, LPC_ORDER:] = _zigzag(x[:, LPC_ORDER:] - _predict(x, coefs, shift))
    cost[:, 1] = (8 + LPC_BITS) * LPC_ORDER + 9 + _rice(u, LPC_ORDER, parts)[1]
    kind = np.where(cost[:, 1] < cost[:, 0], 9, fixed)
    kind[cost.min(1) + 6 >= 8 * n] = 8
    kind[(x == x[:, :1]).all(1)] = 7
    out: list[bytes] = [b""] * g
    for v in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == v)
        name = {7: "constant", 8: "verbatim", 9: "lpc"}.get(v, "fixed")
        order = LPC_ORDER if v == 9 else v if v < 5 else 0
        for i, b in zip(rows.tolist(), _emit(x[rows], name, order, coefs[rows], shift[rows]), strict=True):
            out[i] = b
    return out


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream (mono, 8 bits, value byte - 128) per non-empty payload, with a seek point per frame."""
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    starts, lengths, numbers, owners = [], [], [], []
    at = 0
    for i, p in enumerate(payloads):
        if not p:
            raise ValueError("a payload needs at least one sample")
        for number, off in enumerate(range(0, len(p), block)):
            starts.append(at + off)
            lengths.append(min(block, len(p) - off))
            numbers.append(number)
            owners.append(i)
        at += len(p)
    start, length = np.array(starts), np.array(lengths)
    bodies: list[bytes] = [b""] * len(starts)
    for n in np.unique(length).tolist() if starts else []:
        rows = np.flatnonzero(length == n)
        for k in range(0, len(rows), LANES):
            part = rows[k : k + LANES]
            x = flat[start[part][:, None] + np.arange(n)].astype(np.int64) - 128
            for i, b in zip(part.tolist(), _encode_frames(x), strict=True):
                bodies[i] = _frame_header(numbers[i], n) + b
    sizes = np.array([len(b) for b in bodies], np.int64)
    ends = sizes.cumsum()
    checks = crc16_many(np.frombuffer(b"".join(bodies), np.uint8), ends - sizes, ends).tolist() if bodies else []
    frames = [b + struct.pack(">H", c) for b, c in zip(bodies, checks, strict=True)]
    out, f = [], 0
    for p in payloads:
        own = frames[f : (f := f + -(-len(p) // block))]
        points, offset = [], 0
        for j, frame in enumerate(own):
            points.append(struct.pack(">QQH", j * block, offset, min(block, len(p) - j * block)))
            offset += len(frame)
        lens = [len(b) for b in own]
        samples = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        packed = RATE_HZ << 44 | 0 << 41 | 7 << 36 | len(p)
        info = struct.pack(">HH", block, block) + min(lens).to_bytes(3, "big") + max(lens).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(samples).digest()
        table = b"".join(points)
        out.append(b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


class Stream:
    """The metadata of a FLAC stream and the places of its frames."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise FlacError("no FLAC marker")
        self.data, at, last, points = data, 4, False, None
        self.md5 = b""
        while not last:
            if at + 4 > len(data):
                raise FlacError("metadata ends early")
            last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            at += 4 + size
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.block, self.md5 = int.from_bytes(body[2:4], "big"), body[18:34]
            elif kind == 3:
                points = np.frombuffer(body, dtype=[("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        if not self.md5:
            raise FlacError("no stream information")
        self.first = at
        self.points = points[points["sample"] != 2**64 - 1] if points is not None else np.empty(0, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])

    @property
    def indexed(self) -> bool:
        """Whether the seek table has every frame."""
        return len(self.points) > 0 and int(self.points["n"].astype(np.int64).sum()) == self.samples

    def header(self, at: int) -> tuple[int, int, int, int]:
        """(samples, channel assignment, bits per sample, where the subframes start) of the frame at a byte."""
        d = self.data
        if at + 6 > len(d) or d[at] != 0xFF or d[at + 1] & 0xFE != 0xF8:
            raise FlacError("no frame where one is expected")
        size_code, rate_code, channels, bits_code = d[at + 2] >> 4, d[at + 2] & 15, d[at + 3] >> 4, d[at + 3] >> 1 & 7
        p = at + 5
        lead = d[at + 4]
        while lead & 0x80 and lead << 1 & 0x80:
            lead <<= 1
            p += 1
        if size_code == 6:
            n, p = d[p] + 1, p + 1
        elif size_code == 7:
            n, p = (d[p] << 8 | d[p + 1]) + 1, p + 2
        elif size_code == 1:
            n = 192
        elif 2 <= size_code <= 5:
            n = 576 << (size_code - 2)
        elif size_code >= 8:
            n = 256 << (size_code - 8)
        else:
            raise FlacError("reserved block size")
        p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
        if crc8(d[at:p]) != d[p]:
            raise FlacError("frame header checksum")
        bits = {0: self.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(bits_code)
        if bits is None or channels > 10:
            raise FlacError("reserved frame header value")
        return n, channels, bits, p + 1


def _decode_lanes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """8-bit mono subframes [frames, n] and which lanes need the plain reader instead."""
    g = len(starts)
    width = int((ends - starts).max())
    index = starts[:, None] + np.arange(width + 4)
    data = np.where(index < ends[:, None], flat[np.minimum(index, len(flat) - 1)], 0).astype(np.uint8)
    out = np.zeros((g, n), np.int32)
    kind = data[:, 0] >> 1
    plain = (data[:, 0] & 0x81) > 0
    plain |= ~((kind < 2) | (kind >= 8) & (kind <= 12) | (kind >= 32))
    constant = kind == 0
    out[constant] = data[constant, 1].view(np.int8)[:, None]
    verbatim = np.flatnonzero((kind == 1) & ~plain)
    if len(verbatim):
        if (ends - starts)[verbatim].min() < n + 1:
            raise FlacError("frame ends early")
        out[verbatim] = np.ascontiguousarray(data[verbatim, 1 : n + 1]).view(np.int8)
    coded = np.flatnonzero((kind >= 8) & ~plain)
    if not len(coded):
        return out, plain
    data, kind = data[coded], kind[coded].astype(np.int64)
    g, wide = len(coded), data.astype(np.int32)
    words = (wide[:, :-2] << 16 | wide[:, 1:-1] << 8 | wide[:, 2:]).ravel()
    stride = data.shape[1] - 2
    bits = np.unpackbits(data[:, :-2], axis=1)
    n_bits = bits.shape[1]
    ones = np.where(bits, np.arange(n_bits, dtype=np.int32), np.int32(n_bits - 1))
    following = np.minimum.accumulate(ones[:, ::-1], axis=1)[:, ::-1].ravel()
    word_base, bit_base, top = np.arange(g) * stride, np.arange(g) * n_bits, n_bits - 1

    def read(pos, count):
        at = np.minimum(pos, top)
        return words.take(word_base + (at >> 3)) >> (24 - (at & 7) - count) & ((1 << count) - 1)

    order = np.where(kind >= 32, (kind & 31) + 1, kind & 7)
    longest = int(order.max())
    linear = kind >= 32
    pos = np.full(g, 8)
    warm = np.zeros((g, max(1, longest)), np.int32)
    for j in range(longest):
        use = j < order
        warm[:, j] = np.where(use, (read(pos, 8) ^ 128) - 128, 0)
        pos += 8 * use
    coefs, shift = np.zeros((g, max(1, longest)), np.int64), np.zeros(g, np.int64)
    for o in range(1, min(longest, 4) + 1):
        coefs[(~linear) & (order == o), :o] = FIXED[o]
    bad = np.zeros(g, bool)
    if linear.any():
        precision = read(pos, 4) + 1
        shift = np.where(linear, (read(pos + 4, 5) ^ 16) - 16, 0).astype(np.int64)
        bad |= linear & ((precision == 16) | (shift < 0))
        precision = np.minimum(precision, 15)
        pos += 9 * linear
        half = 1 << (precision - 1)
        for j in range(longest):
            use = linear & (j < order)
            coefs[:, j] = np.where(use, (read(pos, precision) ^ half) - half, coefs[:, j])
            pos += precision * use
        shift = np.maximum(shift, 0)
    method, parts = read(pos, 2), read(pos + 2, 4)
    pos += 6
    bad |= (method > 1) | (n % (1 << parts) > 0) | (n >> parts < order)
    residual = np.zeros((g, n), np.int32)
    k = np.zeros(g, np.int64)
    k_bits = np.where(method == 1, 5, 4)
    size = np.where(bad, n, n >> parts)
    same = int(size.min()) if (size == size[0]).all() else 0
    for i in range(n):
        fresh = i % same == 0 if same else i % size == 0
        if np.any(fresh):
            got = read(pos, k_bits)
            bad |= fresh & (got == (1 << k_bits) - 1)
            k = np.where(fresh, np.minimum(got, 16), k)
            bad |= k > 15
            pos = pos + k_bits * fresh
        stop = following.take(bit_base + np.minimum(pos, top))
        value = (stop - pos) << k | read(stop + 1, k)
        value = value >> 1 ^ -(value & 1)
        if i >= longest:
            residual[:, i] = value
            pos = stop + 1 + k
        else:
            use = i >= order
            residual[:, i] = np.where(use, value, 0)
            pos = np.where(use, stop + 1 + k, pos)
    over = pos > 8 * (ends - starts)[coded]
    if np.any(over & ~bad):
        raise FlacError("frame ends early")
    signal = residual
    rows = np.flatnonzero(order > 0)
    if len(rows):
        history = np.zeros((len(rows), longest + n), np.int64)
        c, s, o = np.ascontiguousarray(coefs[rows][:, ::-1]), shift[rows], order[rows]
        for i in range(n):
            guess = (history[:, i : i + longest] * c).sum(1) >> s if i else 0
            value = residual[rows, i] + guess
            if i < longest:
                value = np.where(i < o, warm[rows, min(i, longest - 1)], value)
            history[:, longest + i] = value
        signal[rows] = history[:, longest:]
    out[coded] = signal
    plain[coded] |= bad
    return out, plain


class _Bits:
    """A plain bit reader for frames that lanes do not cover; bytes are unpacked as they are needed."""

    STEP = 4096

    def __init__(self, data: memoryview):
        self.data, self.taken, self.text, self.at = data, 0, "", 0

    def _more(self) -> None:
        if self.taken >= len(self.data):
            raise FlacError("frame ends early")
        self.text += "".join(f"{b:08b}" for b in self.data[self.taken : self.taken + self.STEP])
        self.taken += self.STEP

    def unsigned(self, n: int) -> int:
        while self.at + n > len(self.text):
            self._more()
        v = int(self.text[self.at : self.at + n], 2) if n else 0
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.unsigned(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        stop = self.text.find("1", self.at)
        while stop < 0:
            seen = len(self.text)
            self._more()
            stop = self.text.find("1", max(self.at, seen))
        q, self.at = stop - self.at, stop + 1
        return q


def _plain_subframe(b: _Bits, n: int, bits: int) -> list[int]:
    if b.unsigned(1):
        raise FlacError("bad subframe")
    kind, wasted = b.unsigned(6), 0
    if b.unsigned(1):
        wasted = b.unary() + 1
    bits -= wasted
    if kind == 0:
        x = [b.signed(bits)] * n
    elif kind == 1:
        x = [b.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind & 7 if kind < 32 else (kind & 31) + 1
        x = [b.signed(bits) for _ in range(order)]
        coefs, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision = b.unsigned(4) + 1
            shift = b.signed(5)
            if precision == 16 or shift < 0:
                raise FlacError("reserved predictor value")
            coefs = [b.signed(precision) for _ in range(order)]
        method, parts = b.unsigned(2), b.unsigned(4)
        if method > 1 or n % (1 << parts):
            raise FlacError("bad residual")
        width = 5 if method else 4
        for p in range(1 << parts):
            k = b.unsigned(width)
            raw = b.unsigned(5) if k == (1 << width) - 1 else None
            for _ in range((n >> parts) - (order if p == 0 else 0)):
                if raw is None:
                    u = b.unary() << k | b.unsigned(k)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = b.signed(raw)
                x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(coefs)) >> shift))
    else:
        raise FlacError("reserved subframe")
    return [v << wasted for v in x]


def _plain_frame(body: memoryview, n: int, channels: int, bits: int) -> tuple[np.ndarray, int]:
    """[channels, n] samples of a frame's body, and its length in bytes."""
    b = _Bits(body)
    count = channels + 1 if channels < 8 else 2
    x = [np.array(_plain_subframe(b, n, bits + ((channels, c) in ((8, 1), (9, 0), (10, 1)))), np.int64) for c in range(count)]
    if channels == 8:
        x[1] = x[0] - x[1]
    elif channels == 9:
        x[0] = x[0] + x[1]
    elif channels == 10:
        mid, side = x[0] << 1 | x[1] & 1, x[1]
        x = [(mid + side) >> 1, (mid - side) >> 1]
    return np.stack(x), -(-b.at // 8)


def _check_frames(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
    stored = flat[ends - 2].astype(np.uint16) << 8 | flat[ends - 1]
    if (crc16_many(flat, starts, ends - 2) != stored).any():
        raise FlacError("frame checksum")


def decode_frames(streams: list[Stream], wanted: list[range]) -> list[list[np.ndarray]]:
    """Samples [channels, n] of the wanted frames of indexed streams; header and frame checksums are verified."""
    flat = np.frombuffer(b"".join(s.data for s in streams), np.uint8)
    place, at = [], 0
    for i, (s, frames) in enumerate(zip(streams, wanted, strict=True)):
        offsets = [*s.points["offset"].astype(np.int64).tolist(), len(s.data) - s.first]
        for f in frames:
            n, channels, bits, body = s.header(s.first + offsets[f])
            if n != int(s.points["n"][f]):
                raise FlacError("seek point and frame differ")
            place.append((i, f, n, channels, bits, at + s.first + offsets[f], at + body, at + s.first + offsets[f + 1]))
        at += len(s.data)
    out: list[list[np.ndarray]] = [[] for _ in streams]
    if not place:
        return out
    start, body, end = (np.array([p[k] for p in place]) for k in (5, 6, 7))
    if (end > len(flat)).any() or (body + 2 > end).any():
        raise FlacError("frame ends early")
    _check_frames(flat, start, end)
    found: list[np.ndarray | None] = [None] * len(place)
    easy: dict[int, list[int]] = {}
    for j, p in enumerate(place):
        if p[3] == 0 and p[4] == 8:
            easy.setdefault(p[2], []).append(j)
    for n, rows in easy.items():
        for k in range(0, len(rows), LANES):
            part = np.array(rows[k : k + LANES])
            x, plain = _decode_lanes(flat, body[part], end[part] - 2, n)
            for j, samples, hard in zip(part.tolist(), x, plain.tolist(), strict=True):
                if not hard:
                    found[j] = samples[None]
    for j, p in enumerate(place):
        if found[j] is None:
            found[j], size = _plain_frame(memoryview(flat[p[6] : p[7] - 2].tobytes()), *p[2:5])
            if p[6] + size != p[7] - 2:
                raise FlacError("bytes between frames")
        out[p[0]].append(found[j])
    return out


def _decode_unindexed(s: Stream) -> np.ndarray:
    at, blocks, flat, view = s.first, [], np.frombuffer(s.data, np.uint8), memoryview(s.data)
    while at < len(s.data):
        n, channels, bits, body = s.header(at)
        x, size = _plain_frame(view[body:], n, channels, bits)
        if body + size + 2 > len(s.data):
            raise FlacError("frame ends early")
        _check_frames(flat, np.array([at]), np.array([body + size + 2]))
        blocks.append(x)
        at = body + size + 2
    return np.concatenate(blocks, 1) if blocks else np.zeros((s.channels, 0), np.int64)


def decode(medias: list[bytes]) -> list[np.ndarray]:
    """Samples [channels, n] of whole streams; frame checksums, sample count and MD5 are verified."""
    streams = [Stream(m) for m in medias]
    quick = [i for i, s in enumerate(streams) if s.indexed]
    blocks = decode_frames([streams[i] for i in quick], [range(len(streams[i].points)) for i in quick])
    done: dict[int, np.ndarray] = {i: np.concatenate(b, 1) for i, b in zip(quick, blocks, strict=True)}
    out = [done[i] if i in done else _decode_unindexed(s) for i, s in enumerate(streams)]
    for s, x in zip(streams, out, strict=True):
        if s.samples and x.shape[1] != s.samples:
            raise FlacError("sample count")
        if any(s.md5) and s.bits in (8, 16) and hashlib.md5(np.ascontiguousarray(x.T).astype(f"<i{s.bits // 8}").tobytes()).digest() != s.md5:
            raise FlacError("sample digest")
    return out


def read_samples(medias: list[bytes], spans: list[tuple[int, int]]) -> list[np.ndarray]:
    """Samples [channels, stop - start] of a span of each indexed stream; only the frames that hold it are decoded."""
    streams, wanted, cuts = [Stream(m) for m in medias], [], []
    for s, (start, stop) in zip(streams, spans, strict=True):
        if not s.indexed or not 0 <= start < stop <= s.samples:
            raise ValueError("span outside an indexed stream")
        first = s.points["sample"].astype(np.int64)
        low, high = int(np.searchsorted(first, start, "right")) - 1, int(np.searchsorted(first, stop, "left"))
        wanted.append(range(low, high))
        cuts.append((start - int(first[low]), stop - int(first[low])))
    return [np.concatenate(b, 1)[:, a:z] for b, (a, z) in zip(decode_frames(streams, wanted), cuts, strict=True)]


def payload_of(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty), filled up with spaces to a positive multiple of PAYLOAD_UNIT."""
    data = (text or "").encode("utf-8")
    return data.ljust(max(1, -(-len(data) // PAYLOAD_UNIT)) * PAYLOAD_UNIT, b" ")


def feature(x: np.ndarray) -> str:
    """Integers of 8-bit mono samples: sum, energy, zero crossings, peak, sum of absolute differences."""
    v = x.astype(np.int64)
    return ":".join(str(int(n)) for n in (v.sum(), (v * v).sum(), ((v[1:] < 0) != (v[:-1] < 0)).sum(), np.abs(v).max(initial=0), np.abs(np.diff(v)).sum()))


#: Bytes of payloads that are coded at once.
HELD_BYTES = 1_500_000


def _groups(sizes: list[int]):
    """Stretches (first, stop) of rows with bounded bytes, or one row."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= HELD_BYTES or i + 1 == len(sizes):
            yield first, i + 1
            first, held = i + 1, 0


def store_media(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media binary): the text's bytes, and its payload as a FLAC stream. A null text counts as empty."""

    def work(texts: list[str | None]) -> dict[str, list]:
        medias: list[bytes] = []
        for a, z in _groups([len(t or "") for t in texts]):
            medias += encode([payload_of(t) for t in texts[a:z]])
        return {"n_bytes": [len((t or "").encode("utf-8")) for t in texts], "media": medias}

    return map_texts(df, work, "n_bytes long, media binary", text_col, (id_col,))


def pcm_blocks(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(id, blocks): decoded PCM blocks of each stream with the sample offset where each starts.

    blocks is an array of (sample_offset, n_samples, channels, pcm), PCM little-endian and
    interleaved, one byte a sample up to 8 bits and four above. A null stream gives null; a broken
    one raises FlacError.
    """
    def work(medias: list[bytes | None]) -> dict[str, list]:
        out = []
        for m in medias:
            if m is None:
                out.append(None)
                continue
            s, x = Stream(bytes(m)), decode([bytes(m)])[0]
            kind = "i1" if s.bits <= 8 else "<i4"
            step = s.block or BLOCK
            out.append([
                {"sample_offset": a, "n_samples": min(step, x.shape[1] - a), "channels": len(x), "pcm": np.ascontiguousarray(x[:, a : a + step].T).astype(kind).tobytes()}
                for a in range(0, x.shape[1], step)
            ])
        return {"blocks": out}

    kind = "blocks array<struct<sample_offset:long,n_samples:int,channels:int,pcm:binary>>"
    return map_texts(df, work, kind, media_col, (id_col,))


def described(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Per stored stream: the columns `keep`, payload_bytes, payload_sha256, tail_crc32 (read by seeking), media_bytes, media_sha256, feature.

    A null stream gives nulls; a broken one raises FlacError.
    """
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")

    def work(given: list[bytes | None]) -> dict[str, list]:
        out: dict[str, list] = {n: [None] * len(given) for n in names}
        there = [i for i, m in enumerate(given) if m is not None]
        for a, z in _groups([len(given[i]) for i in there]):
            medias = [bytes(given[i]) for i in there[a:z]]
            read = decode(medias)
            tails = read_samples(medias, [(max(0, x.shape[1] - 16), x.shape[1]) for x in read])
            for i, m, x, tail in zip(there[a:z], medias, read, tails, strict=True):
                back = (x[0] + 128).astype(np.uint8).tobytes()
                values = (
                    len(back), hashlib.sha256(back).hexdigest(), zlib.crc32((tail[0] + 128).astype(np.uint8).tobytes()),
                    len(m), hashlib.sha256(m).hexdigest(), feature(x[0]),
                )
                for name, v in zip(names, values, strict=True):
                    out[name][i] = v
        return out

    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(df, work, made, media_col, keep)


def media_digests(df: DataFrame) -> DataFrame:
    """Write every whole text as a FLAC column to the shared folder, read the column back and describe what was read.

    Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature. Null and empty texts are a payload of spaces; rows are independent, so that repeated
    rows and null ids stand for themselves and equal texts give equal values; an empty table gives
    no rows, and other columns are ignored.
    """
    return described(written(store_media(df), "media", codec="zstd"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents(spark, sf_dir))
