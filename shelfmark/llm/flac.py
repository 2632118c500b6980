"""FLAC streams of bytes as 8-bit samples: an encoder and a checking decoder that work on many frames at once.

Encoding: mono, 8 bits, byte - 128; each frame takes the shortest of constant, verbatim, fixed predictors of order 0 to 2
and a quantised linear predictor of order 4, with one Rice partition.  A seek table gives the sample number and byte
offset of every frame.

Decoding: frames are lanes.  All lanes take one sample per step: read a Rice code, add the prediction, move on.  Any
number of Rice partitions, either parameter width, escaped partitions and predictors of order up to 32 are read; frame
header CRC-8, frame CRC-16 and the stream's MD5 are verified.  Streams without a seek point for each frame are decoded
in rounds, one frame of each known start per round.  Only mono streams of 8 bits and fixed block size are accepted.

Defined cases: a null text is an empty one, whose payload is one block of padding; null or repeated ids are rows like
any others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .buffers import lean, raw, slices

BLOCK = 576
RATE = 8000
PAD = 255
LPC_ORDER, LPC_BITS = 4, 12
#: Frames that are encoded at once (40 kB of temporaries each), and that are decoded side by side, where a step costs the same for few.
ENCODED, LANES = 512, 2048
#: Bytes of payloads and streams in one batch of results, or one row.
BATCH_BYTES = 1 << 20


def _crc_table(poly: int, width: int, word: int) -> np.ndarray:
    """CRC of every message word of `word` bits."""
    top, mask = 1 << (width - 1), (1 << width) - 1
    crc = np.arange(1 << word, dtype=np.uint32) << np.uint32(width - word)
    for _ in range(word):
        crc = np.where(crc & top, (crc << np.uint32(1)) ^ np.uint32(poly), crc << np.uint32(1)) & np.uint32(mask)
    return crc


CRC8 = _crc_table(0x07, 8, 8).astype(np.uint8)
CRC16 = _crc_table(0x8005, 16, 16).astype(np.uint16)


def _right(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows data[start:end], right-aligned over zeros, an even number of bytes: leading zeros leave a CRC from 0 as it is."""
    wide = int((ends - starts).max())
    wide += wide & 1
    at = ends[:, None] - wide + np.arange(wide)
    return np.where(at >= starts[:, None], data[np.maximum(at, 0)], np.uint8(0))


def crc8(rows: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(rows), np.uint8)
    for column in rows.T:
        crc = CRC8[crc ^ column]
    return crc


def crc16(rows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view(">u2").T.astype(np.uint16)
    crc = np.zeros(len(rows), np.uint16)
    for column in words:
        crc = CRC16[crc ^ column]
    return crc


def _crc_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, crc: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """CRC of each data[start:end]."""
    return np.concatenate([crc(_right(data, starts[i : i + ENCODED], ends[i : i + ENCODED])) for i in range(0, len(starts), ENCODED)])


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    out = []
    first = 0x3F
    while n > first:
        out.append(0x80 | (n & 0x3F))
        n >>= 6
        first >>= 1
    return bytes([(~(2 * first + 1) & 0xFF) | n, *out[::-1]])


def _block_code(size: int) -> tuple[int, bytes]:
    if size % 576 == 0 and size // 576 in (1, 2, 4, 8):
        return 2 + (size // 576).bit_length() - 1, b""
    return (6, bytes([size - 1])) if size <= 256 else (7, struct.pack(">H", size - 1))


def _quantised_lpc(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, shifts) of each row by autocorrelation and Levinson-Durbin."""
    f = x.astype(np.float64)
    corr = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : f.shape[1] - k]) for k in range(order + 1)], axis=1)
    error = corr[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(f), order))
    for i in range(order):
        k = (corr[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], corr[:, i:0:-1])) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(most)).astype(int), 0, 14)
    top = 2 ** (LPC_BITS - 1)
    return np.clip(np.round(a * (2.0 ** shift)[:, None]), -top, top - 1).astype(np.int64), shift


def _residuals(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
    order = coefs.shape[-1]
    n = x.shape[1]
    pred = sum((coefs[:, j : j + 1] if coefs.ndim == 2 else int(coefs[j])) * x[:, order - 1 - j : n - 1 - j] for j in range(order)) if order else 0
    return x[:, order:] - (pred >> (shift[:, None] if isinstance(shift, np.ndarray) else shift) if order else 0)


#: Coefficients of the fixed predictors, by order.
FIXED = [np.array(c, np.int64) for c in ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])]


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zigzag values, parameter, bits) of each row."""
    u = ((residual << 1) ^ (residual >> 63)).astype(np.int32)
    guess = np.clip(np.floor(np.log2(u.mean(axis=1) * 0.69 + 1e-3)).astype(int), 0, 14)
    best_k, best = guess, np.full(len(u), 1 << 40)
    for step in (0, 1):
        k = np.clip(guess + step, 0, 14)
        bits = (u >> k[:, None]).sum(axis=1) + u.shape[1] * (k + 1)
        best_k, best = np.where(bits < best, k, best_k), np.minimum(best, bits)
    return u, best_k, best


def _put(bits: np.ndarray, column: int, value: np.ndarray | int, width: int) -> int:
    for j in range(width):
        bits[:, column + j] = (value >> (width - 1 - j)) & 1
    return column + width


def encode_frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of equal size: x is frames by samples, -128 to 127; numbers are the frames' places in their streams."""
    n = x.shape[1]
    x = x.astype(np.int64)
    kinds: list[tuple[int, np.ndarray | None, np.ndarray | int]] = [(i, FIXED[i], 0) for i in range(3) if i < n]
    if n > 2 * LPC_ORDER:
        kinds.append((LPC_ORDER, *_quantised_lpc(x, LPC_ORDER)))
    tried = [_rice(_residuals(x, coefs, shift)) for _, coefs, shift in kinds]
    cost = np.stack([t[2] + 18 + 8 * order + (9 + order * LPC_BITS) * (i == 3) for i, ((order, _, _), t) in enumerate(zip(kinds, tried, strict=True))])
    choice = cost.argmin(axis=0)
    choice[cost.min(axis=0) >= 8 + 8 * n] = 4  # verbatim
    choice[(x == x[:, :1]).all(axis=1)] = 5  # constant
    bodies: list[bytes] = [b""] * len(x)
    for kind in range(6):
        rows = np.flatnonzero(choice == kind)
        if not len(rows):
            continue
        if kind >= 4:
            plain = (x[rows] & 255).astype(np.uint8)
            for r, body in zip(rows, plain if kind == 4 else plain[:, :1], strict=True):
                bodies[r] = (b"\x02" if kind == 4 else b"\x00") + body.tobytes()
            continue
        order, coefs, shift = kinds[kind]
        u, k = tried[kind][0][rows], tried[kind][1][rows]
        bits = np.zeros((len(rows), int(cost[kind][rows].max()) + 7 & ~7), np.uint8)
        at = _put(bits, 0, ((0x20 | (order - 1)) if kind == 3 else (0x08 | order)) << 1, 8)
        for j in range(order):
            at = _put(bits, at, x[rows, j] & 255, 8)
        if kind == 3:
            at = _put(bits, _put(bits, at, LPC_BITS - 1, 4), shift[rows], 5)
            for j in range(order):
                at = _put(bits, at, coefs[rows, j] & (2**LPC_BITS - 1), LPC_BITS)
        at = _put(bits, _put(bits, at, 0, 6), k, 4)
        code = (1 << k[:, None]) | (u & ((1 << k[:, None]) - 1))
        last = np.cumsum((u >> k[:, None]) + k[:, None] + 1, axis=1) + (at - 1)
        flat, base = bits.ravel(), np.arange(len(rows))[:, None] * bits.shape[1]
        for j in range(int(k.max()) + 1):
            some = k >= j
            if some.all():
                flat[base + last - j] = (code >> j) & 1
            else:
                flat[(base + last)[some] - j] = (code[some] >> j) & 1
        packed = np.packbits(bits, axis=1)
        for r, row, size in zip(rows, packed, (last[:, -1] + 8) // 8, strict=True):
            bodies[r] = row[:size].tobytes()
    code, extra = _block_code(n)
    heads = [bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + _utf8_number(i) + extra for i in numbers]

    def checked(parts: list[bytes], crc: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        ends = np.cumsum([len(p) for p in parts])
        return _crc_of(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], ends[:-1]]), ends, crc)

    frames = [h + bytes([c]) + b for h, c, b in zip(heads, checked(heads, crc8).tolist(), bodies, strict=True)]
    return [f + struct.pack(">H", c) for f, c in zip(frames, checked(frames, crc16).tolist(), strict=True)]


def container(payload: bytes, frames: list[bytes], block: int) -> bytes:
    """The stream: marker, STREAMINFO, a SEEKTABLE with a point for each frame, frames."""
    sizes = [len(f) for f in frames]
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest()
    seek = np.zeros(len(frames), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
    seek["sample"] = np.arange(len(frames)) * block
    seek["offset"] = np.cumsum([0, *sizes[:-1]])
    seek["count"] = block
    seek["count"][-1] = len(payload) - (len(frames) - 1) * block
    table = seek.tobytes()
    if len(table) >= 1 << 24:  # a metadata block's length has 24 bits: keep every k-th point
        table = seek[:: -(-len(table) // ((1 << 24) - 1))].tobytes()
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table + b"".join(frames)


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """Payloads of one byte or more; all frames of a stream but the last have block samples."""
    full: list[tuple[int, int]] = []
    frames: list[list[bytes]] = [[b""] * -(-len(p) // block) for p in payloads]
    for i, p in enumerate(payloads):
        whole, rest = divmod(len(p), block)
        full += [(i, k) for k in range(whole)]
        if rest:
            frames[i][whole] = encode_frames((np.frombuffer(p, np.uint8, rest, whole * block)[None, :].astype(np.int16) - 128), [whole])[0]
    data = np.frombuffer(b"".join(p[: len(p) // block * block] for p in payloads), np.uint8).reshape(-1, block)
    for at in range(0, len(full), ENCODED):
        own = full[at : at + ENCODED]
        for (i, k), f in zip(own, encode_frames(data[at : at + ENCODED].astype(np.int16) - 128, [k for _, k in own]), strict=True):
            frames[i][k] = f
    return [container(p, f, block) for p, f in zip(payloads, frames, strict=True)]


class _Bits:
    """Reads bit fields of many lanes from one buffer."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.zeros(len(data) + 8, np.uint64)
        for j in range(8):
            words <<= np.uint64(8)
            words |= padded[j : j + len(words)]
        self.words = words

    def window(self, at: np.ndarray) -> np.ndarray:
        """The bits from `at` on, at the top of 64; the first 57 are valid."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        """Unsigned fields of width 1 to 57."""
        return (self.window(at) >> (np.uint64(64) - np.asarray(width, np.uint64))).astype(np.int64)

    def signed(self, at: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        v = self.take(at, width)
        return v - ((v >> (np.asarray(width) - 1)) << np.asarray(width))


ZEROS = np.concatenate([[16], 15 - np.floor(np.log2(np.arange(1, 1 << 16))).astype(np.int64)]).astype(np.uint8)


def _rice_codes(bits: _Bits, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signed residual, position after it) of each lane."""
    w = bits.window(at)
    q = ZEROS[w >> np.uint64(48)].astype(np.int64)
    long = q == 16
    if long.any():
        for i in np.flatnonzero(long):
            while ZEROS[int(bits.window(at[i : i + 1])[0]) >> 48] == 16:
                at[i] += 16
                q[i] += 16
            more = int(ZEROS[int(bits.window(at[i : i + 1])[0]) >> 48])
            at[i] += more
            q[i] += more - 16
        at = np.where(long, at + 1, at + q + 1)
        w = bits.window(at)
    else:
        w = w << (q + 1).astype(np.uint64)
        at = at + q + 1
    low = (w >> np.uint64(1)) >> (63 - k).astype(np.uint64)
    u = (q << k) | low.astype(np.int64)
    return (u >> 1) ^ -(u & 1), at + k


def _decode_lanes(data: np.ndarray, bits: _Bits, starts: np.ndarray, expect: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(samples + 128, bytes where the frames end, kind of subframe) of a frame for each lane; expect: frame numbers; size: samples left."""
    head = data[np.minimum(starts[:, None] + np.arange(4), len(data) - 1)]
    if not ((head[:, 0] == 0xFF) & (head[:, 1] == 0xF8) & (head[:, 2] & 15 == 4) & (head[:, 3] == 2)).all():
        raise ValueError("a frame header is missing or not mono, 8 bits, fixed block size")
    number, at = np.zeros(len(starts), np.int64), starts + 4
    first = data[at]
    extra = np.array([0] * 0xC0 + [1] * 32 + [2] * 16 + [3] * 8 + [4] * 4 + [5] * 2 + [6] * 2)[first]
    number = np.where(extra == 0, first, first & (0x3F >> extra)).astype(np.int64)
    for j in range(1, int(extra.max()) + 1):
        number = np.where(extra >= j, number << 6 | (data[np.minimum(at + j, len(data) - 1)] & 0x3F), number)
    at = at + 1 + extra
    code = head[:, 2] >> 4
    n = np.where(code == 1, 192, np.where((code >= 2) & (code <= 5), 576 << np.maximum(code.astype(int) - 2, 0) % 8, 256 << np.maximum(code.astype(int) - 8, 0)))
    n = np.where(code == 6, data[at].astype(int) + 1, np.where(code == 7, (data[at].astype(int) << 8 | data[np.minimum(at + 1, len(data) - 1)]) + 1, n))
    at = at + (code == 6) + 2 * (code == 7)
    if (number != expect).any() or (n > size).any():
        raise ValueError("a frame has the wrong number or size")
    if (_crc_of(data, starts, at, crc8) != data[at]).any():
        raise ValueError("a frame header's CRC-8 differs")
    sub = data[at + 1].astype(np.int64)
    if (sub & 0x81).any():
        raise ValueError("a subframe with wasted bits or a bad mark")
    kind = sub >> 1
    at = (at + 2) * 8
    samples: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(starts)
    for group in sorted({*zip(n.tolist(), np.where(kind >= 8, 2, kind).tolist(), strict=True)}):
        rows = np.flatnonzero((n == group[0]) & (np.where(kind >= 8, 2, kind) == group[1]))
        if group[1] < 2:
            wide = group[0] if group[1] else 1
            got = data[at[rows, None] // 8 + np.arange(wide)] ^ 128
            for r, s in zip(rows, got, strict=True):
                samples[r] = s if group[1] else np.repeat(s, group[0])
            at[rows] += 8 * wide
        else:
            out, at[rows] = _predicted(bits, at[rows], kind[rows], group[0])
            out += 128
            for r, s in zip(rows, np.ascontiguousarray(out.astype(np.uint8).T), strict=True):
                samples[r] = s
    ends = (at + 7) // 8
    if (_crc_of(data, starts, ends, crc16) != (data[ends].astype(np.uint16) << 8 | data[ends + 1])).any():
        raise ValueError("a frame's CRC-16 differs")
    return samples, ends + 2, kind


def _predicted(bits: _Bits, at: np.ndarray, kind: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed and linear predictor subframes of n samples: (samples by lanes, bit positions after)."""
    linear = kind >= 32
    if (~linear & (kind > 12)).any():
        raise ValueError("a reserved subframe type")
    order = np.where(linear, kind - 31, kind - 8)
    deep, lanes = int(order.max()), len(at)
    out = np.zeros((deep + n, lanes), np.int64)
    for i in range(deep):
        on = i < order
        out[deep + i] = np.where(on, bits.signed(at, 8), 0)
        at = at + 8 * on
    coefs, shift = np.zeros((deep, lanes), np.int64), np.zeros(lanes, np.int64)
    for o in range(1, min(4, deep) + 1):
        for j in range(o):
            coefs[j, ~linear & (order == o)] = FIXED[o][j]
    if linear.any():
        wide = np.where(linear, bits.take(at, 4) + 1, 1)
        shift = np.where(linear, bits.signed(at + 4, 5), 0)
        if (shift < 0).any():
            raise ValueError("a negative predictor shift")
        at = at + 9 * linear
        for j in range(deep):
            on = linear & (j < order)
            coefs[j] = np.where(on, bits.signed(at, wide), coefs[j])
            at = at + np.where(on, wide, 0)
    method, part = bits.take(at, 2), bits.take(at + 2, 4)
    at = at + 6
    if (method > 1).any():
        raise ValueError("a reserved residual coding")
    field, every = 4 + method, n >> part
    k, escape = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    steps = {int(p) for e in np.unique(every) for p in range(0, n, max(1, int(e)))}
    for i in range(n):
        on = order <= i
        if i in steps:  # a partition begins for some lanes, at its first sample or, in the first one, at the header
            new = i % every == 0
            got = bits.take(at, field)
            k = np.where(new, got, k)
            at = at + np.where(new, field, 0)
            raw_width = new & (k == (1 << field) - 1)
            escape = np.where(new, np.where(raw_width, bits.take(at, 5), -1), escape)
            at = at + 5 * raw_width
            odd = bool((escape >= 0).any())
        if odd:
            width = np.maximum(escape, 0)
            coded, after = _rice_codes(bits, at.copy(), np.where(escape >= 0, 0, k))
            value = np.where(escape >= 0, np.where(width > 0, bits.signed(at, np.maximum(width, 1)), 0), coded)
            after = np.where(escape >= 0, at + width, after)
        else:
            value, after = _rice_codes(bits, at if i >= deep else at.copy(), k)
        row = deep + i
        for j in range(deep):
            if j == 0:
                pred = coefs[0] * out[row - 1]
            else:
                pred += coefs[j] * out[row - 1 - j]
        if deep:
            value = value + (pred >> shift)
        if i < deep:
            out[row] = np.where(on, value, out[row])
            at = np.where(on, after, at)
        else:
            out[row] = value
            at = after
    return out[deep:], at


def _metadata(stream: memoryview) -> tuple[int, bytes, np.ndarray, int, int]:
    """(total samples, MD5, seek points, where frames begin, block size)."""
    if bytes(stream[:4]) != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, seek = 4, False, b"", np.zeros(0, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
    while not last:
        last, kind, n = stream[at] >= 128, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = bytes(stream[at + 4 : at + 4 + n])
        if kind == 0:
            info = body
        elif kind == 3:
            seek = np.frombuffer(body, seek.dtype)
            seek = seek[seek["sample"] != 2**64 - 1]
        at += 4 + n
    packed = int.from_bytes(info[10:18], "big")
    if (packed >> 36) & 0xFF != 7:
        raise ValueError("not mono of 8 bits")
    return packed & (2**36 - 1), info[18:34], seek, at, int.from_bytes(info[:2], "big")


def decode(streams: list[bytes | memoryview]) -> tuple[list[bytes], list[list[int]]]:
    """(payloads, subframe kinds by frame) of whole streams."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    bits = _Bits(data)
    lanes, infos, base = [], [], 0
    for i, s in enumerate(streams):
        total, md5, seek, first, block = _metadata(memoryview(s))
        infos.append((total, md5, block))
        points = {int(p["sample"]): int(p["offset"]) for p in seek} | ({0: 0} if total else {})
        stops = [*sorted(points)[1:], total]
        lanes += [(i, a, z, base + first + points[a]) for a, z in zip(sorted(points), stops, strict=True)]
        base += len(s)
    out = [np.zeros(total, np.uint8) for total, _, _ in infos]
    kinds: list[dict[int, int]] = [{} for _ in streams]
    while lanes:
        left = []
        for cut in range(0, len(lanes), LANES):
            own = lanes[cut : cut + LANES]
            blocks = np.array([infos[i][2] for i, *_ in own])
            at = np.array([a for _, a, _, _ in own])
            got, ends, kind = _decode_lanes(data, bits, np.array([p for *_, p in own]), at // blocks, np.array([z - a for _, a, z, _ in own]))
            for (i, a, z, _), samples, end, t in zip(own, got, ends.tolist(), kind.tolist(), strict=True):
                out[i][a : a + len(samples)] = samples
                kinds[i][a] = t
                if a + len(samples) < z:
                    left.append((i, a + len(samples), z, end))
        lanes = left
    for o, (_, md5, _) in zip(out, infos, strict=True):
        if hashlib.md5((o ^ 128).tobytes()).digest() != md5:
            raise ValueError("a stream's MD5 differs")
    return [o.tobytes() for o in out], [[k[a] for a in sorted(k)] for k in kinds]


def payload_of(text: bytes, block: int = BLOCK) -> bytes:
    return text + bytes([PAD]) * (-len(text) % block if text else block)


def feature_of(payload: bytes, kinds: list[int]) -> str:
    """A summary of the samples read back and of the subframes they were coded in."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    below = x < 0
    names = {0: "constant", 1: "verbatim"}
    count: dict[str, int] = {}
    for k in kinds:
        name = names.get(k) or (f"fixed{k - 8}" if k < 32 else f"lpc{k - 31}")
        count[name] = count.get(name, 0) + 1
    return json.dumps(
        {
            "samples": len(x),
            "frames": len(kinds),
            "energy": int((x * x).sum(dtype=np.int64)),
            "peak": int(np.abs(x).max()),
            "crossings": int((below[1:] != below[:-1]).sum()),
            "subframes": dict(sorted(count.items())),
        }
    )


STREAMS = "doc_id long, n_bytes long, media binary"
#: media: the whole stream in its first block, else null.  kind: of the frame's subframe.
BLOCKS = "doc_id long, n_bytes long, block long, sample_offset long, samples long, kind int, pcm binary, media binary"
SAMPLES = "doc_id long, n_bytes long, media binary, payload binary, feature string"


@lean
def to_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STREAMS from texts."""
    for batch in batches:
        for rows in slices(batch, "text"):
            data, offsets = raw(rows.column("text"))
            whole = data.tobytes()
            texts = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            media = encode([payload_of(t) for t in texts])
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(media, pa.binary())})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "media"):
            streams = rows.column("media").to_pylist()
            payloads, kinds = decode(streams)
            held = []
            for doc_id, n_bytes, stream, p, own in zip(rows.column("doc_id").to_pylist(), rows.column("n_bytes").to_pylist(), streams, payloads, kinds, strict=True):
                size = _metadata(memoryview(stream))[4]
                held += [(doc_id, n_bytes, k, k * size, len(p), kind, p[k * size : (k + 1) * size], None if k else stream) for k, kind in enumerate(own)]
            columns = list(zip(*held, strict=True)) or [()] * 8
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SAMPLES from BLOCKS in the order they were decoded in."""
    held: list[tuple] = []
    first: tuple = ()
    parts: list[bytes] = []
    kinds: list[int] = []
    size = waiting = 0

    def out() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], [x.split()[0] for x in SAMPLES.split(", ")])

    for batch in batches:
        for doc_id, n_bytes, block, offset, samples, kind, pcm, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block == 0:
                first, parts, kinds, size = (doc_id, n_bytes, media), [], [], 0
            if block != len(parts) or offset != size:
                raise RuntimeError(f"block {block} at sample {offset} came after {size} samples")
            parts.append(pcm)
            kinds.append(kind)
            size += len(pcm)
            if size == samples:
                payload = b"".join(parts)
                own = size + len(first[2])
                if held and waiting + own > BATCH_BYTES:
                    yield out()
                    held.clear()
                    waiting = 0
                held.append((*first, payload, feature_of(payload, kinds)))
                waiting += own
    if held:
        yield out()


@lean
def to_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SAMPLES from streams by way of their BLOCKS, in one worker: blocks that travel through the JVM take a second one beside each task."""
    return _joined(_blocks(batches))


def to_flac(docs: DataFrame) -> DataFrame:
    """STREAMS of docs (doc_id long, text string): each text with its padding as one stream."""
    return docs.select("doc_id", "text").mapInArrow(to_streams, STREAMS)


def pcm_blocks(streams: DataFrame) -> DataFrame:
    """BLOCKS of STREAMS: decoded PCM with the number of each block's first sample, for seeking."""
    return streams.select("doc_id", "n_bytes", "media").mapInArrow(lean(_blocks), BLOCKS)


def from_flac(streams: DataFrame) -> DataFrame:
    """SAMPLES: the streams with the payload put together from their PCM blocks, in place, and its feature."""
    return streams.select("doc_id", "n_bytes", "media").mapInArrow(to_samples, SAMPLES)
