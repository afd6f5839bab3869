"""FLAC media columns: 8-bit mono streams coded and decoded by numpy, many frames at a time.

Frames are lanes: step i of a loop decodes sample i of every frame of a slice of streams, so Rice residuals and
linear predictors cost a few array operations a step. A seek point for each frame gives the lanes their places.
Every header's CRC-8, every frame's CRC-16 and every stream's MD5 are verified.

The encoder cuts a stream into frames of 512 samples and a tail of powers of two times 64, so all Rice partitions
hold 64 samples. It picks the best of constant, verbatim, fixed predictors of order 0 to 2 and a linear predictor
of order 2 for each frame.

Defined results: a null text is empty; a payload is padded with bytes 0 to a positive multiple of 64, so an empty
text is 64 zeros; equal payloads give equal streams; any damage raises ``FlacError``. The decoder reads 8-bit mono
streams with a seek point for each frame; others raise ``FlacError``. A payload of any length is coded and decoded
``SLICE_BYTES`` at a time; repeated rows give repeated rows; an empty table gives an empty table; only the named
columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from undula.llm._arrow import slices, utf8

BLOCK = 512
UNIT = 64
RATE = 8000
PRECISION = 12
SHIFT = 9
#: Samples coded at a time.
SLICE_BYTES = 3 << 19
#: Sample predictors of the fixed orders (fixed values).
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
_LEADING = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


class FlacError(ValueError):
    """A stream that is damaged or of another kind."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        out.append(c & (1 << bits) - 1)
    return np.array(out, np.int64)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(buf: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of buf[start : start + size] of each lane."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    crc, table = np.zeros(len(start), np.int64), _CRC8 if bits == 8 else _CRC16
    live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    for i, a in enumerate(live.tolist()):
        if bits == 8:
            crc[:a] = table[crc[:a] ^ buf[start[:a] + i]]
        else:
            crc[:a] = ((crc[:a] & 0xFF) << 8) ^ table[(crc[:a] >> 8) ^ buf[start[:a] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A sample number in the coded form of frame headers."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < 1 << (6 - len(tail)):
            return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *reversed(tail)])


def cut(size: int) -> list[int]:
    """The frames of a stream of ``size`` samples, a multiple of ``UNIT``."""
    return [BLOCK] * (size // BLOCK) + [UNIT << b for b in (2, 1, 0) if size % BLOCK // UNIT >> b & 1]


def _residuals(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind of subframe, residuals with the warm-up left out as 0, linear coefficients) of equally long frames.

    Kinds: 0 to 2 fixed orders, 3 linear, 4 constant, 5 verbatim.
    """
    n = s.shape[1]
    all_ = [s.copy(), s.copy(), s.copy(), np.zeros_like(s)]
    all_[1][:, 1:] -= s[:, :-1]
    all_[2][:, 2:] -= 2 * s[:, 1:-1] - s[:, :-2]
    f = s.astype(np.float32)
    r0, r1, r2 = (f * f).sum(1), (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = np.maximum(r0.astype(float) ** 2 - r1.astype(float) ** 2, 1e-9)
    a = np.column_stack(((r1 * r0 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det))
    c = np.clip(np.rint(np.nan_to_num(a) * (1 << SHIFT)), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int32)
    all_[3][:, 2:] = s[:, 2:] - ((c[:, :1] * s[:, 1:-1] + c[:, 1:] * s[:, :-2]) >> SHIFT)
    cost = np.column_stack([np.abs(x[:, o:]).sum(1) + 6 * o + (24 if k == 3 else 0) for k, (x, o) in enumerate(zip(all_, (0, 1, 2, 2)))])
    kind = cost.argmin(1)
    kind[(s == s[:, :1]).all(1)] = 4
    res = np.choose(np.minimum(kind, 3)[:, None], all_)
    for o in (1, 2, 3):
        res[kind == o, : min(o, 2)] = 0
    return kind, res, c


_ORDER = np.array([0, 1, 2, 2, 0, 0])


def _encode_frames(s: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all frames one after the other, start of each, size of each) of equally long frames, int32 (frames, n)."""
    lanes, n = s.shape
    kind, res, coef = _residuals(s)
    u = (res << 1) ^ (res >> 31)
    parts = n // UNIT
    per = u.reshape(lanes, parts, UNIT)
    order = _ORDER[kind]
    count = np.full((lanes, parts), UNIT)
    count[:, 0] -= order
    bits_by_k = np.stack([(per >> k).sum(2) + count * (1 + k) for k in range(9)])
    k = bits_by_k.argmin(0)
    body = bits_by_k.min(0).sum(1) + 4 * parts
    head = np.where(kind == 3, 8 * 2 + 4 + 5 + 2 * PRECISION, 8 * order) + 6
    kind = np.where((kind < 4) & (body + head >= 8 * n), 5, kind)
    order = _ORDER[kind]
    rice = kind < 4
    bits = 8 + np.where(kind == 4, 8, np.where(kind == 5, 8 * n, head + body))
    first = [bytes([0xFF, 0xF9, ({512: 9, 256: 8}.get(n, 6) << 4) | 4, 2]) + _number(int(x)) + (b"" if n >= 256 else bytes([n - 1])) for x in number]
    hsize = np.array([len(h) + 1 for h in first])
    size = hsize + -(-bits // 8) + 2
    start = np.cumsum(size) - size
    plane = np.zeros(8 * int(size.sum()), np.uint8)
    pos = 8 * (start + hsize)

    def put(lane, value, width):
        for j in range(width):
            plane[pos[lane] + width - 1 - j] = (value >> j) & 1
        pos[lane] += width

    every = np.arange(lanes)
    put(every, np.choose(kind, [8 << 1, 9 << 1, 10 << 1, 33 << 1, 0, 1 << 1]), 8)
    for at in np.flatnonzero(kind == 4)[None, :]:
        put(at, s[at, 0] & 0xFF, 8)
    at = np.flatnonzero(kind == 5)
    if len(at):
        plane[pos[at][:, None] + np.arange(8 * n)] = np.unpackbits((s[at] & 0xFF).astype(np.uint8), axis=1)
    for o in (0, 1):
        at = np.flatnonzero(rice & (order > o))
        put(at, s[at, o] & 0xFF, 8)
    at = np.flatnonzero(kind == 3)
    put(at, np.full(len(at), PRECISION - 1), 4)
    put(at, np.full(len(at), SHIFT), 5)
    for o in (0, 1):
        put(at, coef[at, o], PRECISION)
    at = np.flatnonzero(rice)
    put(at, np.full(len(at), parts.bit_length() - 1), 6)
    if len(at):
        ku, uu = k[at], u[at]
        kk = np.repeat(ku, UNIT, axis=1)
        q = uu >> kk
        length = q + 1 + kk
        length[:, 0][order[at] > 0] = 0
        length[:, 1][order[at] > 1] = 0
        extra = np.zeros((len(at), n), np.int64)
        extra[:, ::UNIT] = 4
        end = pos[at][:, None] + np.cumsum(length + extra, axis=1)
        mark = end[:, ::UNIT] - length[:, ::UNIT]  # where each partition's parameter ends
        for j in range(4):
            plane[mark - 1 - j] = (ku >> j) & 1
        some = length > 0
        end, kk, uu = end[some], kk[some], uu[some]
        plane[end - kk - 1] = 1
        for j in range(int(kk.max(initial=0))):
            m = kk > j
            plane[end[m] - 1 - j] = (uu[m] >> j) & 1
    buf = np.packbits(plane)
    flat = np.frombuffer(b"".join(first), np.uint8)
    hs = hsize - 1
    buf[np.repeat(start - (np.cumsum(hs) - hs), hs) + np.arange(len(flat))] = flat
    buf[start + hs] = _crc(buf, start, hs, 8)
    crc = _crc(buf, start, size - 2, 16)
    buf[start + size - 2], buf[start + size - 1] = crc >> 8, crc & 0xFF
    return buf, start, size


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose bytes less 128 are its samples; lengths are positive multiples of ``UNIT``."""
    cuts = [cut(len(p)) for p in payloads]
    sizes = np.array([n for c in cuts for n in c])
    number = np.concatenate([np.cumsum([0, *c[:-1]]) for c in cuts])
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    begin = np.cumsum(sizes) - sizes
    frames: list[bytes] = [b""] * len(sizes)
    for n in np.unique(sizes):
        alike = np.flatnonzero(sizes == n)
        for lot in range(0, len(alike), SLICE_BYTES // int(n)):
            at = alike[lot : lot + SLICE_BYTES // int(n)]
            buf, start, size = _encode_frames(raw[begin[at][:, None] + np.arange(n)].astype(np.int32) - 128, number[at])
            data = buf.tobytes()
            for i, a, b in zip(at.tolist(), start.tolist(), (start + size).tolist()):
                frames[i] = data[a:b]
    out, f = [], 0
    for payload, c in zip(payloads, cuts):
        own = frames[f : f + len(c)]
        lengths = [len(x) for x in own]
        points = np.zeros(len(c), _POINT)
        points["sample"], points["count"] = number[f : f + len(c)], c
        points["offset"] = np.cumsum(lengths) - lengths
        f += len(c)
        md5 = hashlib.md5((np.frombuffer(payload, np.uint8) - np.uint8(128)).tobytes()).digest()
        info = struct.pack(">HH", min(c) if len(c) > 1 else max(c), max(c)) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5
        table = points.tobytes()
        out.append(b"fLaC" + struct.pack(">I", 34) + info + struct.pack(">I", 0x83 << 24 | len(table)) + table + b"".join(own))
    return out


def open_stream(data: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """(samples, MD5, seek points, offset of the first frame)."""
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, info, points = 4, False, None, None
    while not last:
        if at + 4 > len(data):
            raise FlacError("the metadata is cut off")
        word = struct.unpack_from(">I", data, at)[0]
        last, kind, size = bool(word >> 31), word >> 24 & 0x7F, word & 0xFFFFFF
        block = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            if (packed >> 41 & 7, packed >> 36 & 31) != (0, 7):
                raise FlacError("only 8-bit mono streams are read")
            info = packed & (1 << 36) - 1, block[18:34]
        elif kind == 3:
            points = np.frombuffer(block, _POINT)
            points = points[points["sample"] != 2**64 - 1]
        at += 4 + size
    if info is None or points is None or not len(points) or points["sample"][0] or not (points["sample"][:-1] + points["count"][:-1] == points["sample"][1:]).all() or points["sample"][-1] + points["count"][-1] != info[0]:
        raise FlacError("the stream has no seek point for each frame")
    return *info, points, at


def decode_frames(buf: np.ndarray, start: np.ndarray, size: np.ndarray, samples: np.ndarray, number: np.ndarray) -> np.ndarray:
    """int32 (longest frame, frames): the samples of each frame, of buf[start : start + size]; checks headers and CRCs."""
    lanes = len(start)
    buf = np.concatenate((buf, np.zeros(16, np.uint8)))
    word = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))
    b = [buf[start + i].astype(np.int64) for i in range(5)]
    if ((b[0] != 0xFF) | (b[1] & 0xFE != 0xF8) | (b[3] & 0xF1 != 0) | ~np.isin(b[3] >> 1 & 7, (0, 1))).any():
        raise FlacError("a frame has no header of an 8-bit mono frame")
    code = b[2] >> 4
    ones = _LEADING[(~(b[4] << 8)) & 0xFFFF] * (b[4] >= 0x80)
    width = np.maximum(ones, 1)
    coded = np.where(ones > 0, b[4] & (0x7F >> np.maximum(ones, 1)), b[4])
    for i in range(1, int(width.max(initial=1))):
        coded = np.where(width > i, coded << 6 | buf[start + 4 + i] & 0x3F, coded)
    end = start + 4 + width
    given = np.where(code == 6, buf[end].astype(np.int64) + 1, (buf[end].astype(np.int64) << 8 | buf[end + 1]) + 1)
    count = np.select([code == 1, (code >= 2) & (code <= 5), (code == 6) | (code == 7), code >= 8], [192, 576 << np.maximum(code - 2, 0), given, 256 << np.maximum(code - 8, 0)], 0)
    end = end + (code == 6) + 2 * (code == 7)
    rate = b[2] & 15
    end = end + (rate == 12) + 2 * ((rate == 13) | (rate == 14))
    if (_crc(buf, start, end - start, 8) != buf[end]).any():
        raise FlacError("a frame header's checksum doesn't match")
    if (_crc(buf, start, size - 2, 16) != (buf[start + size - 2].astype(np.int64) << 8 | buf[start + size - 1])).any():
        raise FlacError("a frame's checksum doesn't match")
    if (count != samples).any() or ((b[1] & 1 == 1) & (coded != number)).any():
        raise FlacError("a frame isn't where its seek point says")
    pos = 8 * (end + 1)

    def peek(p):
        return word[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)

    def take(lane, bits):
        """``bits`` (1 to 32, for each lane) bits as unsigned numbers."""
        bits = np.broadcast_to(np.asarray(bits, np.int64), lane.shape)
        v = (peek(pos[lane]) >> (64 - bits).astype(np.uint64)).astype(np.int64)
        pos[lane] += bits
        return v

    def signed(v, bits):
        return v - ((v >> bits - 1 & 1) << bits)

    longest = int(count.max(initial=0))
    out = np.zeros((longest, lanes), np.int32)
    every = np.arange(lanes)
    head = take(every, 8)
    if (head & 0x81).any():
        raise FlacError("wasted bits are not read")
    kind = head >> 1
    for lane in np.flatnonzero(kind == 0)[None, :]:
        out[:, lane] = np.where(np.arange(longest)[:, None] < count[lane], signed(take(lane, 8), 8), 0)
    for n in np.unique(count[kind == 1]):
        lane = np.flatnonzero((kind == 1) & (count == n))
        out[:n, lane] = (buf[(pos[lane] >> 3)[:, None] + np.arange(n)].view(np.int8).astype(np.int32)).T
    lanes_ = np.flatnonzero(((kind >= 8) & (kind <= 12)) | (kind >= 32))
    if len(lanes_) + ((kind == 0) | (kind == 1)).sum() != lanes:
        raise FlacError("a subframe of a reserved kind")
    if not len(lanes_):
        return out
    lane = lanes_[np.argsort(-count[lanes_], kind="stable")]
    n, kind = count[lane], kind[lane]
    order = np.where(kind >= 32, kind - 31, kind - 8)
    deepest = int(order.max(initial=0))
    x = np.zeros((longest, len(lane)), np.int64)
    for o in range(deepest):
        at = np.flatnonzero(order > o)
        x[o, at] = signed(take(lane[at], 8), 8)
    coef, shift = np.zeros((deepest, len(lane)), np.int64), np.zeros(len(lane), np.int64)
    for o in range(1, 5):
        for j, c in enumerate(FIXED[o][:deepest]):
            coef[j, kind == 8 + o] = c
    at = np.flatnonzero(kind >= 32)
    if len(at):
        precision = take(lane[at], 4) + 1
        shift[at] = take(lane[at], 5)
        for o in range(deepest):
            some = order[at] > o
            coef[o, at[some]] = signed(take(lane[at[some]], precision[some]), precision[some])
    method = take(lane, 2)
    if (method > 1).any():
        raise FlacError("a residual of a reserved kind")
    per = n >> take(lane, 4)
    wide = 4 + method
    p, live = pos[lane], np.searchsorted(-n, -np.arange(longest), "left")
    k, raw = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    turns = np.unique(np.concatenate([np.arange(0, longest, s) for s in np.unique(per)]))
    turns = set(turns.tolist())
    one, top = np.uint64(1), np.uint64(48)
    has_raw = False
    for i, a in enumerate(live.tolist()):
        if i in turns:
            m = np.flatnonzero(i % per[:a] == 0)
            v = (peek(p[m]) >> (64 - wide[m]).astype(np.uint64)).astype(np.int64)
            p[m] += wide[m]
            k[m], raw[m] = v, 0
            e = m[v == (1 << wide[m]) - 1]
            if len(e):
                raw[e] = (peek(p[e]) >> np.uint64(59)).astype(np.int64) + 1
                p[e] += 5
                k[e] = 0
            has_raw = bool(raw[:a].any())
        q_p, kk = p[:a], k[:a]
        v = peek(q_p)
        q = _LEADING[(v >> top).astype(np.intp)]
        far = np.flatnonzero(q == 16)
        while len(far):  # long runs of zeros
            more = _LEADING[(peek(q_p[far] + q[far]) >> top).astype(np.intp)]
            q[far] += more
            far = far[more == 16]
            if len(far) and (q_p[far] > 8 * len(buf) - 128).any():
                raise FlacError("a residual runs out of its stream")
        skip = q + 1
        rest = np.where(q < 16, v << np.minimum(skip, 63).astype(np.uint64), 0) if (q < 16).all() else peek(q_p + skip)
        u = q << kk | ((rest >> one) >> (63 - kk).astype(np.uint64)).astype(np.int64)
        r = (u >> 1) ^ -(u & 1)
        used = skip + kk
        if has_raw:
            e = np.flatnonzero(raw[:a])
            r[e] = signed((peek(q_p[e]) >> (64 - np.maximum(raw[e] - 1, 1)).astype(np.uint64)).astype(np.int64), np.maximum(raw[e] - 1, 1)) * (raw[e] > 1)
            used[e] = raw[e] - 1
        if i < deepest:
            on = order[:a] <= i
            used *= on
            r = np.where(on, r, x[i, :a])
        p[:a] += used
        if deepest and i:
            pred = coef[0, :a] * x[i - 1, :a]
            for j in range(1, min(deepest, i)):
                pred += coef[j, :a] * x[i - 1 - j, :a]
            pred >>= shift[:a]
            if i < deepest:
                pred *= on
            r += pred
        x[i, :a] = r
    out[:, lane] = x
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream of ``encode``."""
    opened = [open_stream(s) for s in streams]
    buf = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *(len(s) for s in streams)])
    start, size = [], []
    for b, e, (_, _, points, at) in zip(base[:-1].tolist(), base[1:].tolist(), opened):
        o = points["offset"].astype(np.int64) + b + at
        start.append(o)
        size.append(np.diff(np.append(o, e)))
    start, size = np.concatenate(start), np.concatenate(size)
    count = np.concatenate([o[2]["count"] for o in opened]).astype(np.int64)
    number = np.concatenate([o[2]["sample"] for o in opened]).astype(np.int64)
    flat, done = np.empty(int(count.sum()), np.int8), 0
    lots = np.searchsorted(np.cumsum(count), np.arange(0, len(flat), SLICE_BYTES), "right")
    for a, b in zip(lots.tolist(), [*lots[1:].tolist(), len(count)]):
        if a < b:
            own = buf[start[a] : start[b - 1] + size[b - 1]]
            x = decode_frames(own, start[a:b] - start[a], size[a:b], count[a:b], number[a:b])
            part = np.ascontiguousarray(x.T.astype(np.int8))[np.arange(x.shape[0]) < count[a:b, None]]
            flat[done : done + len(part)] = part
            done += len(part)
    ends = np.cumsum([o[0] for o in opened])
    out = []
    for a, e, (_, md5, _, _) in zip([0, *ends[:-1].tolist()], ends.tolist(), opened):
        own = flat[a:e]
        if hashlib.md5(own.tobytes()).digest() != md5:
            raise FlacError("a stream's MD5 doesn't match")
        out.append((own.view(np.uint8) + np.uint8(128)).tobytes())
    return out


def read_at(stream: bytes, sample: int, count: int) -> bytes:
    """Samples ``sample`` to ``sample + count`` of a stream, decoding only the frames that hold them."""
    total, _, points, at = open_stream(stream)
    end = min(sample + count, total)
    if not 0 <= sample < end:
        return b""
    a, b = (int(np.searchsorted(points["sample"], s, "right")) - 1 for s in (sample, end - 1))
    offset = np.append(points["offset"].astype(np.int64) + at, len(stream))
    x = decode_frames(np.frombuffer(stream, np.uint8), offset[a : b + 1], np.diff(offset[a : b + 2]), points["count"][a : b + 1].astype(np.int64), points["sample"][a : b + 1].astype(np.int64))
    flat = x.T[np.arange(x.shape[0]) < points["count"][a : b + 1].astype(np.int64)[:, None]]
    first = int(points["sample"][a])
    return (flat[sample - first : end - first].astype(np.int8).view(np.uint8) + np.uint8(128)).tobytes()


def pad(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_bytes, media binary: a FLAC stream) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part in slices(batches, 1, SLICE_BYTES):
            rows = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([len(t) for t in rows], pa.int64()), pa.array(encode([pad(t) for t in rows]), pa.binary())], ["key", "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def feature(pcm: bytes) -> str:
    """Root mean square, share of sign changes and mean step of the samples, as text."""
    raw = np.frombuffer(pcm, np.uint8)
    squares = changes = steps = 0
    for a in range(0, len(raw), SLICE_BYTES):
        s = raw[a : a + SLICE_BYTES + 1].astype(np.int32) - 128
        squares += int((s[:SLICE_BYTES] ** 2).sum())
        changes += int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)))
        steps += int(np.abs(np.diff(s)).sum())
    return f"rms={np.sqrt(squares / len(raw)):.4f};zcr={changes / len(raw):.5f};step={steps / max(len(raw) - 1, 1):.4f}"


def load(media: DataFrame, key: str) -> DataFrame:
    """(key, n_bytes, media, pcm binary: 8-bit unsigned samples, blocks: seekable (sample, offset, count), feature) of every row."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        for part in slices(batches, 2, SLICE_BYTES):
            streams = part.column(2).to_pylist()
            pcm = decode(streams)
            points = [open_stream(x)[2] for x in streams]
            each = np.concatenate(points)
            fields = [pa.array(each["sample"].astype(np.int64)), pa.array(each["offset"].astype(np.int64)), pa.array(each["count"].astype(np.int32))]
            ends = np.cumsum([0, *(len(x) for x in points)]).astype(np.int32)
            seek = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["sample", "offset", "count"]))
            yield pa.record_batch(
                [*(part.column(i) for i in range(3)), pa.array(pcm, pa.binary()), seek, pa.array([feature(p) for p in pcm])],
                ["key", "n_bytes", "media", "pcm", "blocks", "feature"],
            )

    out = f"key {kind}, n_bytes long, media binary, pcm binary, blocks array<struct<sample long, offset long, count int>>, feature string"
    return media.select(key, "n_bytes", "media").mapInArrow(run, out).withColumnRenamed("key", key)
