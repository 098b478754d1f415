"""Media columns: lossless FLAC in binary columns.

encode_media stores each text's payload (its UTF-8 bytes, filled up with bytes
255 to a positive multiple of 576) as one mono 8-bit FLAC stream: STREAMINFO
with the MD5 of the samples, a SEEKTABLE with one point a frame, frames of 576
samples.  Each frame takes the cheapest of the fixed predictors of order 0, 1 and
2 and a linear predictor of order LPC_ORDER (autocorrelation, quantised), with its
best Rice parameter, or is stored verbatim or as a constant where that is shorter.
A payload byte b is the sample b - 128.

decode_media reads such streams back: CRC-8 of headers, CRC-16 of frames,
Rice partitions (both methods, with escapes), constant, verbatim, fixed and
LPC subframes, then the MD5.  pcm_blocks gives the decoded samples as blocks
with their first sample's number, and read_pcm any range of samples: both decode
only the frames that the seek table names.

Frames are independent, so numpy works on many frames side by side: a step
handles the i-th residual of each.  The plan is narrow.

Null and empty texts have a payload of 576 bytes 255; very long texts are worked
on AT_ONCE bytes of frames at a time; copies, repeated and null ids have equal
results by row; an empty table gives an empty result; other columns are ignored.
Damaged streams raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heritas.llm.common import prepare

BLOCK = 576
RATE = 8000
#: Order of the linear predictor, and bits of a coefficient.
LPC_ORDER, LPC_BITS = 4, 8
#: Bits a sample that a linear predictor has to save, as it takes longer to decode.
LPC_GAIN = 0.3
#: Payload bytes that numpy handles at once (memory bound of a worker).
AT_ONCE = 2 << 20

# ---- checksums ------------------------------------------------------------


def _crc_table(poly: int, bits: int, length: int) -> np.ndarray:
    """[i, b]: the checksum of byte b followed by i zero bytes.  As the code is
    linear and starts at 0, a message's checksum is the XOR of its bytes'."""
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    one = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) & mask if c & top else c << 1 & mask
        one.append(c)
    step = np.array(one, np.uint32)
    out = np.empty((length, 256), np.uint16)
    row = step
    for i in range(length):
        out[i] = row
        row = (row << np.uint32(8) & np.uint32(mask)) ^ step[row >> np.uint32(bits - 8)]
    return out


class _Crc:
    def __init__(self, poly: int, bits: int):
        self.poly, self.bits, self.table = poly, bits, _crc_table(poly, bits, 16)

    def rows(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Checksums of the byte ranges [start, start + size)."""
        most = int(size.max(initial=0))
        if most > len(self.table):
            self.table = _crc_table(self.poly, self.bits, most + 64)
        out = np.zeros(len(start), np.uint16)
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            if n:
                raw = flat[start[own][:, None] + np.arange(n)]
                out[own] = np.bitwise_xor.reduce(self.table[np.arange(n - 1, -1, -1), raw], axis=1)
        return out


#: Fixed values of the format: generator polynomials.
CRC8, CRC16 = _Crc(0x07, 8), _Crc(0x8005, 16)


def _coded_number(n: int) -> bytes:
    """A frame's number in the header's variable-length form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([0xFF ^ (room * 2 + 1) | n, *reversed(tail)])


# ---- encoder --------------------------------------------------------------


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def _linear(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals, quantised coefficients and shifts of linear predictors, by the
    Levinson-Durbin recursion over the rows' autocorrelations."""
    x = s.astype(np.float64)
    auto = np.stack([(x[:, i:] * x[:, : BLOCK - i]).sum(1) for i in range(LPC_ORDER + 1)])
    coef, error = np.zeros((LPC_ORDER, len(s))), np.maximum(auto[0], 1e-9)
    for i in range(LPC_ORDER):
        k = (auto[i + 1] - (coef[:i] * auto[i:0:-1]).sum(0)) / error
        coef[:i] -= k * coef[:i][::-1].copy()
        coef[i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(coef).max(0), 1e-9)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(most)).astype(np.int64), 0, 15)
    top = (1 << (LPC_BITS - 1)) - 1
    q = np.clip(np.rint(coef * (1 << shift)), -top - 1, top).astype(np.int32)
    guess = np.zeros_like(s)
    for j in range(LPC_ORDER):
        guess[:, LPC_ORDER:] += q[j][:, None] * s[:, LPC_ORDER - 1 - j : BLOCK - 1 - j]
    return s - (guess >> shift.astype(np.int32)[:, None]), q, shift


def _frames(samples: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the rows of samples: (all bytes, first byte of each frame and the end)."""
    s = samples.astype(np.int32)
    first = np.zeros_like(s)
    first[:, 1:] = s[:, 1:] - s[:, :-1]
    second = np.zeros_like(s)
    second[:, 2:] = first[:, 2:] - first[:, 1:-1]
    linear, coef, shift = _linear(s)
    weight = np.stack([np.abs(r[:, o:]).sum(1) for o, r in enumerate((s, first, second))])
    order = weight.argmin(0)
    # What a linear predictor's coefficients cost counts against it: so many bits
    # fewer a sample, as the residuals' logarithm.
    gain = np.log2(np.maximum(weight.min(0), 1) / np.maximum(np.abs(linear[:, LPC_ORDER:]).sum(1), 1)) * BLOCK
    lpc = gain > 9 + LPC_ORDER * (LPC_BITS + 8) + LPC_GAIN * BLOCK
    order[lpc] = LPC_ORDER
    res = np.where(lpc[:, None], linear, s)
    res[order == 1] = first[order == 1]
    res[order == 2] = second[order == 2]
    res[np.arange(BLOCK) < order[:, None]] = 0
    u = (res << 1) ^ (res >> 31)
    mean = np.maximum(u.sum(1) / BLOCK, 1)
    low = np.clip(np.log2(mean).astype(np.int64), 0, 9)
    coded = BLOCK - order
    head = np.where(lpc, 9 + LPC_ORDER * LPC_BITS, 0)
    tries = [np.clip(low + d, 0, 14) for d in (-1, 0, 1)]
    cost = [(u >> t[:, None]).sum(1) + (t + 1) * coded for t in tries]
    k = np.choose(np.argmin(cost, axis=0), tries)
    bits = np.min(cost, axis=0) + 8 * order + 10 + head
    constant = (s == s[:, :1]).all(1)
    verbatim = ~constant & (bits >= 8 * BLOCK)
    rice = ~constant & ~verbatim

    codes = [_coded_number(x) for x in range(int(number.max(initial=0)) + 1)]
    length = np.array([len(x) for x in codes], np.int64)[number]
    body = np.where(constant, 1, np.where(verbatim, BLOCK, -(-bits // 8)))
    size = 4 + length + 1 + 1 + body + 2
    stop = np.cumsum(size)
    start = stop - size
    out = np.zeros(int(stop[-1]) + 4, np.uint8)
    for i, x in enumerate((0xFF, 0xF8, 0x20, 0x02)):
        out[start + i] = x
    coded_bytes = np.zeros((len(codes), 7), np.uint8)
    for i, x in enumerate(codes):
        coded_bytes[i, : len(x)] = list(x)
    for i in range(int(length.max())):
        own = np.flatnonzero(length > i)
        out[start[own] + 4 + i] = coded_bytes[number[own], i]
    out[start + 4 + length] = CRC8.rows(out, start, 4 + length)
    sub = start + 5 + length
    out[sub] = np.where(constant, 0, np.where(verbatim, 2, np.where(lpc, 31 + order, 8 | order) << 1))
    raw = samples.view(np.uint8)
    out[sub[constant] + 1] = raw[constant, 0]
    own = np.flatnonzero(verbatim)
    out[sub[own][:, None] + 1 + np.arange(BLOCK)] = raw[own]
    own = np.flatnonzero(rice)
    if len(own):
        o, kk = order[own], k[own]
        for i in range(LPC_ORDER):
            with_warm = own[o > i]
            out[sub[with_warm] + 1 + i] = raw[with_warm, i]
        # Bit fields: first bit, value, width.
        at, fields = (sub[own] + 1 + o) * 8, []
        has = lpc[own]
        fields.append((at[has], (LPC_BITS - 1) << 5 | shift[own][has], np.full(int(has.sum()), 9)))
        for j in range(LPC_ORDER):
            fields.append((at[has] + 9 + j * LPC_BITS, coef[j][own][has].astype(np.int64) & ((1 << LPC_BITS) - 1), np.full(int(has.sum()), LPC_BITS)))
        at = at + head[own]
        # 2 bits method, 4 bits partition order, 4 bits parameter
        fields.append((at, kk, np.full(len(at), 10)))
        v = u[own]
        q = v >> kk[:, None]
        use = np.arange(BLOCK) >= o[:, None]
        end = (at + 10)[:, None] + np.cumsum(np.where(use, q + 1 + kk[:, None], 0), axis=1)
        word = (1 << kk[:, None]) | (v & ((1 << kk[:, None]) - 1))
        fields.append(((end - (kk + 1)[:, None])[use], word[use].astype(np.int64), np.broadcast_to((kk + 1)[:, None], use.shape)[use]))
        begin, word, width = (np.concatenate(x) for x in zip(*fields))
        word = word << (24 - (begin & 7) - width)
        byte = begin >> 3
        for i, part in enumerate((word >> 16, word >> 8 & 255, word & 255)):
            out += np.bincount(byte + i, weights=part, minlength=len(out)).astype(np.uint8)[: len(out)]
    crc = CRC16.rows(out, start, size - 2)
    out[stop - 2] = crc >> 8
    out[stop - 1] = crc & 255
    return out[:-4], np.append(start, stop[-1])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload (positive multiples of 576 bytes)."""
    if not payloads:
        return []
    signed = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8)
    count = np.array([len(p) // BLOCK for p in payloads])
    begin = np.cumsum(count) - count
    number = np.arange(int(count.sum())) - np.repeat(begin, count)
    rows, step, parts, ends = signed.reshape(-1, BLOCK), AT_ONCE // BLOCK, [], [np.zeros(1, np.int64)]
    for i in range(0, len(rows), step):
        flat, where = _frames(rows[i : i + step], number[i : i + step])
        parts.append(flat.tobytes())
        ends.append(ends[-1][-1] + where[1:])
    at, body, out = np.concatenate(ends), b"".join(parts), []
    for p, a, n in zip(payloads, begin.tolist(), count.tolist()):
        where = at[a : a + n + 1]
        sizes = np.diff(where)
        total = n * BLOCK
        info = BLOCK.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | total).to_bytes(8, "big") + hashlib.md5(signed[a * BLOCK : (a + n) * BLOCK].tobytes()).digest()
        seek = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        seek["sample"] = np.arange(n) * BLOCK
        seek["offset"] = where[:-1] - where[0]
        seek["n"] = BLOCK
        table = seek.tobytes()
        out.append(b"fLaC" + b"\0" + (34).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + body[where[0] : where[-1]])
    return out


# ---- decoder --------------------------------------------------------------

#: Fixed values of the format: predictor coefficients by order.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
_ZEROS = np.array([16] + [15 - x.bit_length() + 1 for x in range(1, 1 << 16)], np.int64)


class _Bits:
    """Big-endian bit reads at many places of a buffer at once."""

    def __init__(self, flat: np.ndarray):
        padded = np.concatenate([flat, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.word = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16)) | (padded[2:-1] << np.uint32(8)) | padded[3:]
        self.end = len(flat) * 8

    def window(self, pos: np.ndarray) -> np.ndarray:
        """32 bits from pos on; the upper 25 hold."""
        return self.word[pos >> 3] << (pos & 7).astype(np.uint32)

    def take(self, pos: np.ndarray, n) -> np.ndarray:
        """n (0 to 24) bits from pos on."""
        n = np.asarray(n)
        return np.where(n > 0, self.window(pos) >> np.minimum(32 - n, 31).astype(np.uint32), 0).astype(np.int64)

    def signed(self, pos: np.ndarray, n: int) -> np.ndarray:
        x = self.take(pos, n)
        return np.where(x >> (n - 1) & 1, x - (1 << n), x)

    def zeros(self, pos: np.ndarray) -> np.ndarray:
        """How many 0 bits come before the next 1."""
        out = _ZEROS[self.window(pos) >> np.uint32(16)]
        more = np.flatnonzero(out == 16)
        total = np.full(len(more), 16, np.int64)
        while len(more):
            if (pos[more] + total > self.end).any():
                raise ValueError("a Rice code doesn't end")
            z = _ZEROS[self.window(pos[more] + total) >> np.uint32(16)]
            total = total + z
            out[more] = total
            more, total = more[z == 16], total[z == 16]
        return out


def _residuals(bits: _Bits, pos: np.ndarray, block: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of frames that share block size and predictor order."""
    method = bits.take(pos, 2)
    parts = bits.take(pos + 2, 4)
    if len(pos) and ((method > 1).any() or (block & ((1 << int(parts.max())) - 1))):
        raise ValueError("residual coding is reserved or doesn't fit the block")
    wide = np.where(method == 1, 5, 4)
    pos = pos + 6
    each = block >> parts
    k = np.zeros(len(pos), np.int64)
    raw = np.zeros(len(pos), np.int64)
    escaped = np.zeros(len(pos), bool)
    out = np.zeros((block, len(pos)), np.int64)
    starts = {order} | {x for e in np.unique(each).tolist() for x in range(e, block, e) if x > order}
    any_escape = False
    for i in range(order, block):
        if i in starts:
            now = (i % each == 0) | (i == order)
            value = bits.take(pos, wide)
            k = np.where(now, value, k)
            pos = pos + np.where(now, wide, 0)
            e = now & (value == (1 << wide) - 1)
            escaped = np.where(now, e, escaped)
            raw = np.where(e, bits.take(pos, 5), raw)
            pos = pos + np.where(e, 5, 0)
            any_escape = bool(escaped.any())
        z = bits.zeros(pos) if not any_escape else np.where(escaped, 0, bits.zeros(np.where(escaped, 0, pos)))
        if any_escape:
            rest = bits.take(pos + np.where(escaped, 0, z + 1), np.where(escaped, raw, k))
            u = z << np.where(escaped, 0, k) | rest
            signed = np.where((raw > 0) & (rest >> np.maximum(raw - 1, 0) & 1 > 0), rest - (1 << raw), rest)
            out[i] = np.where(escaped, signed, (u >> 1) ^ -(u & 1))
            pos = pos + np.where(escaped, raw, z + 1 + k)
        else:
            pos += z
            pos += 1
            u = bits.take(pos, k)
            u |= z << k
            pos += k
            out[i] = (u >> 1) ^ -(u & 1)
    return out, pos


def _number_length(lead: np.ndarray) -> np.ndarray:
    ones = np.zeros(len(lead), np.int64)
    going = np.ones(len(lead), bool)
    for b in range(7, 0, -1):
        going &= (lead >> b & 1) == 1
        ones += going
    if (ones == 1).any():
        raise ValueError("bad frame number")
    return np.maximum(ones, 1)


def _decode_frames(flat: np.ndarray, start: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Decode the frames that begin at the bytes `start`: a list of (frames,
    samples (frames x block)), each frame's block size, each frame's end."""
    bits = _Bits(flat)
    padded = np.concatenate([flat, np.zeros(32, np.uint8)])
    b = [padded[start + i].astype(np.int64) for i in range(4)]
    if not ((b[0] == 0xFF) & (b[1] & 0xFE == 0xF8)).all():
        raise ValueError("no frame begins here")
    if not ((b[3] >> 4 == 0) & np.isin(b[3] >> 1 & 7, [0, 1]) & (b[3] & 1 == 0)).all():
        raise ValueError("only mono streams of 8 bits are supported")
    at = start + 4 + _number_length(padded[start + 4])
    code, rate = b[2] >> 4, b[2] & 15
    block = np.select([code == 1, (code >= 2) & (code <= 5), code >= 8], [192, 576 << np.clip(code - 2, 0, 3), 256 << np.clip(code - 8, 0, 7)], 0)
    block = np.where(code == 6, padded[at] + 1, np.where(code == 7, padded[at].astype(np.int64) * 256 + padded[at + 1] + 1, block))
    if (block == 0).any() or (rate == 15).any():
        raise ValueError("reserved block size or sample rate")
    at = at + np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, rate >= 13], [1, 2], 0)
    if (CRC8.rows(padded, start, at - start) != padded[at]).any():
        raise ValueError("a frame header's checksum is wrong")
    head = padded[at + 1].astype(np.int64)
    if (head & 0x81).any():
        raise ValueError("bad subframe header or wasted bits")
    kind = head >> 1
    pos0 = (at + 2) * 8
    end = np.zeros(len(start), np.int64)
    found = []
    for key in np.unique(kind * 65536 + block - 1).tolist():
        t, n = key >> 16, (key & 65535) + 1
        own = np.flatnonzero((kind == t) & (block == n))
        pos = pos0[own]
        if t == 0:
            x = np.repeat(bits.signed(pos, 8)[:, None], n, axis=1)
            pos = pos + 8
        elif t == 1:
            x = padded[(pos >> 3)[:, None] + np.arange(n)].view(np.int8).astype(np.int64)
            pos = pos + 8 * n
        elif 8 <= t <= 12 or t >= 32:
            order = t - 8 if t < 32 else t - 31
            if order > n:
                raise ValueError("the predictor is longer than the block")
            warm = [bits.signed(pos + 8 * i, 8) for i in range(order)]
            pos = pos + 8 * order
            if t < 32:
                coef, shift = np.array(FIXED[order], np.int64)[:, None], 0
            else:
                precision = bits.take(pos, 4) + 1
                shift = bits.take(pos + 4, 5)
                if (precision == 16).any() or (shift > 15).any():
                    raise ValueError("reserved precision or negative shift")
                pos, coef = pos + 9, np.empty((order, len(own)), np.int64)
                for j in range(order):
                    c = bits.take(pos, precision)
                    coef[j] = np.where(c >> (precision - 1) & 1, c - (1 << precision), c)
                    pos = pos + precision
            res, pos = _residuals(bits, pos, n, order)
            for i in range(order):
                res[i] = warm[i]
            if t == 9:
                res = np.cumsum(res, axis=0)
            elif order:
                for i in range(order, n):
                    res[i] += (coef * res[i - order : i][::-1]).sum(0) >> shift
            x = res.T
        else:
            raise ValueError("reserved subframe type")
        end[own] = -(-pos // 8)
        found.append((own, x))
    if (end + 2 > len(flat)).any():
        raise ValueError("the stream ends inside a frame")
    crc = CRC16.rows(padded, start, end - start)
    if (crc != padded[end].astype(np.uint16) * 256 + padded[end + 1]).any():
        raise ValueError("a frame's checksum is wrong")
    return found, block, end + 2


def _parse(media: bytes) -> tuple[int, bytes, int, np.ndarray | None]:
    """(samples, MD5, where the frames begin, the frames' offsets if the seek table has all)."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, points, least = 4, False, 0, b"", None, BLOCK
    while not last:
        last, kind, size = bool(media[at] & 128), media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        own = media[at + 4 : at + 4 + size]
        if len(own) != size:
            raise ValueError("metadata ends early")
        if kind == 0:
            word = int.from_bytes(own[10:18], "big")
            total, md5, least = word & (1 << 36) - 1, own[18:34], int.from_bytes(own[:2], "big")
            if word >> 41 & 7 or (word >> 36 & 31) != 7:
                raise ValueError("only mono streams of 8 bits are supported")
        elif kind == 3:
            points = np.frombuffer(own, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        at += 4 + size
    if points is not None and len(points) and int(points["n"].sum()) == total and (points["sample"] == np.arange(len(points)) * least).all():
        return total, md5, at, points["offset"].astype(np.int64)
    return total, md5, at, None


def _samples(flat: np.ndarray, begins: np.ndarray):
    """Samples and block sizes of the frames that begin at `begins`, so many at a
    time as have AT_ONCE bytes."""
    at = 0
    while at < len(begins):
        stop = max(at + 1, int(np.searchsorted(begins, begins[at] + AT_ONCE)))
        end = begins[stop] if stop < len(begins) else len(flat)
        found, block, _ = _decode_frames(flat[begins[at] : end], begins[at:stop] - begins[at])
        last = np.cumsum(block)
        out = np.empty(int(last[-1]), np.int8)
        for own, x in found:
            if len(x) and ((x < -128) | (x > 127)).any():
                raise ValueError("a sample is out of range")
            out[(last - block)[own][:, None] + np.arange(x.shape[1])] = x
        yield out, block
        at = stop


def read_pcm(media: bytes, first: int, n: int) -> bytes:
    """Samples first to first + n (as unsigned bytes) of a stream with a full
    seek table: only their frames are decoded, and their checksums verified."""
    total, _, at, offsets = _parse(media)
    if offsets is None:
        return decode([media])[0][first : first + n]
    stop = min(first + n, total)
    if first >= stop:
        return b""
    size = _frame_samples(media)
    lo, hi = first // size, -(-stop // size)
    end = at + int(offsets[hi]) if hi < len(offsets) else len(media)
    flat = np.frombuffer(media, np.uint8)[at + int(offsets[lo]) : end]
    out = np.concatenate([x for x, _ in _samples(flat, offsets[lo:hi] - offsets[lo])])
    return (out.view(np.uint8) ^ 0x80)[first - lo * size : stop - lo * size].tobytes()


def _frame_samples(media: bytes) -> int:
    """Samples of each frame but the last (STREAMINFO comes first)."""
    return int.from_bytes(media[8:10], "big")


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of FLAC streams; checks all checksums."""
    if not streams:
        return []
    parsed = [_parse(m) for m in streams]
    base = np.cumsum([0] + [len(m) for m in streams])
    flat = np.frombuffer(b"".join(streams), np.uint8)
    begins, owner = [], []
    for i, (m, (total, _, at, offsets)) in enumerate(zip(streams, parsed)):
        if offsets is None:  # no seek table: walk the frames
            offsets, done, here, own = [], 0, at, np.frombuffer(m, np.uint8)
            while done < total:
                _, block, end = _decode_frames(own, np.array([here]))
                offsets.append(here - at)
                done, here = done + int(block[0]), int(end[0])
            offsets = np.array(offsets, np.int64)
        begins.append(base[i] + at + offsets)
        owner.append(np.full(len(offsets), i))
    begins, owner = np.concatenate(begins), np.concatenate(owner)
    blocks, parts = [], []
    for raw, block in _samples(flat, begins):
        parts.append(raw)
        blocks.append(block)
    out, block = np.concatenate([np.zeros(0, np.int8), *parts]), np.concatenate([np.zeros(0, np.int64), *blocks])
    result, count = [], np.bincount(owner, weights=block, minlength=len(streams)).astype(np.int64)
    at = 0
    for (total, md5, _, _), n in zip(parsed, count.tolist()):
        own = out[at : at + n]
        at += n
        if n != total or (any(md5) and hashlib.md5(own.tobytes()).digest() != md5):
            raise ValueError("the samples' MD5 or number is wrong")
        result.append((own.view(np.uint8) ^ 0x80).tobytes())
    return result


# ---- the operator ---------------------------------------------------------


def _by_size(rows: list, size) -> list[list]:
    out, held = [], AT_ONCE
    for r in rows:
        if held + size(r) > AT_ONCE:
            out.append([])
            held = 0
        out[-1].append(r)
        held += size(r)
    return out


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a FLAC stream)."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            at = 0
            for texts in _by_size(b.column(1).to_pylist(), lambda t: 4 * len(t or "") + BLOCK):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(encode([payload(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(payload: bytes) -> str:
    """mean, root mean square, peak and sign changes of the samples."""
    total = squares = peak = turns = 0
    for i in range(0, len(payload), AT_ONCE):
        x = (np.frombuffer(payload[max(0, i - 1) : i + AT_ONCE], np.uint8) ^ 0x80).view(np.int8).astype(np.int32)
        turns += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[i > 0 :]
        total, squares, peak = total + int(x.sum(dtype=np.int64)), squares + int((x * x).sum(dtype=np.int64)), max(peak, int(np.abs(x).max()))
    return f"mean={total / len(payload):.4f};rms={np.sqrt(squares / len(payload)):.4f};peak={peak};turns={turns}"


def decode_media(media: DataFrame) -> DataFrame:
    """Read streams back: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches):
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), [x.as_py() for x in b.column(2)]))
            for part in _by_size(rows, lambda r: len(r[2])):
                back = decode([r[2] for r in part])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([r[0] for r in part], pa.int64()),
                        "n_bytes": pa.array([r[1] for r in part], pa.int64()),
                        "payload_bytes": pa.array([len(p) for p in back], pa.int64()),
                        "payload_sha256": [hashlib.sha256(p).hexdigest() for p in back],
                        "tail_crc32": pa.array([zlib.crc32(p[-32:]) for p in back], pa.int64()),
                        "media_bytes": pa.array([len(r[2]) for r in part], pa.int64()),
                        "media_sha256": [hashlib.sha256(r[2]).hexdigest() for r in part],
                        "feature": [features(p) for p in back],
                    }
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pcm_blocks(media: DataFrame, samples: int = 16 * BLOCK) -> DataFrame:
    """Decoded samples (unsigned bytes) as blocks: doc_id, first_sample, n_samples,
    pcm.  A block is read by the seek table, so a long stream is never whole in
    memory."""

    def run(batches):
        for b in batches:
            for doc, m in zip(b.column(0).to_pylist(), b.column(1)):
                stream = m.as_py()
                total = _parse(stream)[0]
                for first in range(0, total, AT_ONCE // samples * samples or samples):
                    whole = read_pcm(stream, first, AT_ONCE // samples * samples or samples)
                    cut = [whole[i : i + samples] for i in range(0, len(whole), samples)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc] * len(cut), pa.int64()), "first_sample": pa.array(range(first, first + len(whole), samples), pa.int64()), "n_samples": pa.array([len(c) for c in cut], pa.int32()), "pcm": pa.array(cut, pa.binary())})

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, first_sample long, n_samples int, pcm binary")
