"""A FLAC codec in numpy over many frames at once.

Frames advance in step: sample i of all frames of a batch is decoded by the same few array operations,
so the Rice codes, whose lengths are only known one after the other, cost no Python per sample.

The decoder reads ordinary streams: 1 to 8 channels, 4 to 24 bits, fixed and varying block sizes, constant, verbatim, fixed and linear
subframes, wasted bits, and the three ways to code stereo. Frames are found by their sync codes, headers' CRC-8 and frames' CRC-16; a seek table
is used where it lists every frame. Samples are checked by their MD5 where the stream has one.

The encoder writes mono 8-bit streams: each frame takes the cheapest of the fixed predictors and of a linear predictor of order
``LINEAR``, made from whole-number autocorrelations, so that equal frames give equal bytes wherever they stand.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

BLOCK = 256
RATE = 8000
#: Order of the encoder's linear predictors, and the bits of their coefficients.
LINEAR, PRECISION = 4, 12
#: Bits a sample by the frame header's code; 0: the stream's own, -1: reserved or not read.
DEPTHS = np.array([0, 8, 12, -1, 16, 20, 24, -1])
SEEK = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])


def crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.int64)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)
ZEROS = np.array([16, *(16 - x.bit_length() for x in range(1, 1 << 16))], np.int64)


def crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The CRC of each stretch of ``data``; longest first, so that those still running are a prefix."""
    wide = 8 if table is CRC16 else 0
    order = np.argsort(-length, kind="stable")
    at, left, out = start[order], length[order], np.zeros(len(start), np.int64)
    running = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
    for j, m in enumerate(running):
        c = out[:m]
        out[:m] = ((c << 8) & 0xFF00 if wide else 0) ^ table[(c >> wide) ^ data[at[:m] + j]]
    back = np.empty_like(out)
    back[order] = out
    return back


def put_bits(size: int, pos: np.ndarray, value: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bytes with each value (16 bits at most) written at its bit position; fields do not overlap."""
    lanes = value << (24 - width - (pos & 7))
    at, out = pos >> 3, np.zeros(size)
    for lane in range(3):
        out += np.bincount(at + lane, weights=(lanes >> (16 - 8 * lane)) & 255, minlength=size)[:size]
    return out.astype(np.uint8)


def utf8_length(number: np.ndarray) -> np.ndarray:
    return 1 + sum((number >= limit).astype(np.int64) for limit in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26))


def linear_predictors(s: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts for each row of samples, by Levinson and Durbin's recursion."""
    wide = s.astype(np.int64)
    r = np.stack([(wide[:, j:] * wide[:, : wide.shape[1] - j]).sum(1) for j in range(order + 1)], 1).astype(float)
    a, error = np.zeros((len(s), order)), np.maximum(r[:, 0], 1e-9)
    for i in range(order):
        k = r[:, i + 1].copy()
        for j in range(i):
            k -= a[:, j] * r[:, i - j]
        k /= error
        before = a[:, :i].copy()
        for j in range(i):
            a[:, j] = before[:, j] - k * before[:, i - 1 - j]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.abs(a).max(1)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(top, 1e-9))).astype(np.int64), 0, 15)
    most = (1 << PRECISION - 1) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -most, most).astype(np.int64), shift


def encode(payload: np.ndarray, offsets: np.ndarray, linear: bool | None = None) -> list[bytes]:
    """A FLAC stream for each row of ``payload``; row lengths are positive multiples of 64.

    Each frame takes the fixed predictor of order 0 to 4 with the smallest residual, or a linear one where that is smaller by more than its
    coefficients (``linear`` True: always, False: never); frames of one value are constant subframes.
    """
    size = np.diff(offsets)
    frames = -(-size // BLOCK)
    row = np.repeat(np.arange(len(size)), frames)
    number = np.arange(len(row)) - np.repeat(np.cumsum(frames) - frames, frames)
    begin = offsets[row] + number * BLOCK
    count = np.minimum(BLOCK, offsets[row + 1] - begin)
    signed = payload.astype(np.int64) - 128

    head = 4 + utf8_length(number) + (count < BLOCK) + 1
    bits, fields = np.zeros(len(row), np.int64), []  # fields: frame, bit in the frame's body, value, width
    for n in np.unique(count):
        own = np.flatnonzero(count == n)
        s = signed[begin[own][:, None] + np.arange(n)].astype(np.int16)  # differences of order 4 fit
        tries, cost = [s], [np.abs(s[:, 4:]).sum(1, dtype=np.int32)]
        for _ in range(4):
            d = tries[-1].copy()
            d[:, 1:] -= tries[-1][:, :-1]
            tries.append(d)
            cost.append(np.abs(d[:, 4:]).sum(1, dtype=np.int32))
        order = np.argmin(np.stack(cost), 0)
        r = s.astype(np.int32)
        for j in np.unique(order[order > 0]):
            r[order == j] = tries[j][order == j]
        lpc = np.zeros(len(own), bool)
        if linear is not False:
            factors, shift = linear_predictors(s, LINEAR)
            guess = sum(factors[:, j : j + 1] * s[:, LINEAR - 1 - j : n - 1 - j] for j in range(LINEAR)) >> shift[:, None]
            rest = s[:, LINEAR:] - guess
            bits_of = lambda total: (n - 4) * np.log2(np.maximum(1.0, total / (n - 4)))
            lpc = np.full(len(own), True) if linear else bits_of(np.abs(rest).sum(1)) + 9 + LINEAR * PRECISION < bits_of(np.stack(cost).min(0))
            lpc &= (np.abs(rest) < 1 << 14).all(1)
            order = np.where(lpc, LINEAR, order)
            r[lpc, :LINEAR], r[lpc, LINEAR:] = s[lpc, :LINEAR], rest[lpc]
        constant = (s == s[:, :1]).all(1)
        order, lpc = np.where(constant, 0, order), lpc & ~constant
        coded = (np.arange(n) >= order[:, None]) & ~constant[:, None]
        z = np.where(coded, (r << 1) ^ (r >> 31), 0)
        mean = z.sum(1) / (n - order)
        k = np.maximum(np.floor(np.log2(np.maximum(1, mean * 0.69))).astype(np.int64), 0)
        k = np.minimum(14, np.maximum(k, np.ceil(np.log2((z.max(1) + 1) / 15 + 1e-9)).astype(np.int64)))  # runs of zeros stay short
        k = k.astype(np.int32)
        q = z >> k[:, None]
        kind = np.where(constant, 0, np.where(lpc, 32 + LINEAR - 1, 8 + order))
        warm = np.where(constant, 1, order)
        rice = 8 + 8 * warm
        fields.append((own, np.zeros(len(own), np.int64), kind << 1, np.full(len(own), 8)))
        for j in range(int(warm.max())):
            has = warm > j
            fields.append((own[has], np.full(has.sum(), 8 + 8 * j), s[has, j] & 255, np.full(has.sum(), 8)))
        if lpc.any():
            place = rice[lpc]
            fields.append((own[lpc], place, (PRECISION - 1) << 5 | shift[lpc], np.full(len(place), 9)))
            for j in range(LINEAR):
                fields.append((own[lpc], place + 9 + PRECISION * j, factors[lpc, j] & ((1 << PRECISION) - 1), np.full(len(place), PRECISION)))
            rice = rice + np.where(lpc, 9 + PRECISION * LINEAR, 0)
        has = ~constant
        fields.append((own[has], rice[has], k[has], np.full(has.sum(), 10)))
        length = np.where(coded, q + 1 + k[:, None], 0)
        after = np.cumsum(length, 1, dtype=np.int32)
        stop = rice[:, None] + 10 + after - k[:, None] - 1
        value = (np.int32(1) << k[:, None]) | (z & ((np.int32(1) << k[:, None]) - 1))
        fields.append((np.repeat(own, n)[coded.ravel()], stop[coded], value[coded], np.broadcast_to(k[:, None] + 1, z.shape)[coded]))
        bits[own] = rice + np.where(constant, 0, 10 + after[:, -1])

    length = head + (bits + 7) // 8 + 2
    ahead = 4 + 4 + 34 + 4 + SEEK.itemsize * frames
    total = ahead + np.bincount(row, weights=length, minlength=len(size)).astype(np.int64)
    stream = np.r_[0, np.cumsum(total)]
    before = np.cumsum(length) - length
    start = before - before[np.cumsum(frames) - frames][row] + (stream[:-1] + ahead)[row]
    frame, place, value, width = (np.concatenate(x) for x in zip(*fields, strict=True))
    out = put_bits(int(stream[-1]) + 3, (start + head)[frame] * 8 + place, value, width)

    out[start], out[start + 1] = 0xFF, 0xF8
    out[start + 2] = np.where(count == BLOCK, 0x84, 0x64)
    out[start + 3] = 0x02
    used = utf8_length(number)
    for w in np.unique(used):
        own = used == w
        at, x = start[own] + 4, number[own]
        out[at] = x if w == 1 else ((0xFF << (8 - w)) & 0xFF) | (x >> (6 * (w - 1)))
        for j in range(1, w):
            out[at + j] = 0x80 | (x >> (6 * (w - 1 - j))) & 0x3F
    own = count < BLOCK
    out[start[own] + 4 + used[own]] = count[own] - 1
    out[start + head - 1] = crc(out, start, head - 1, CRC8)
    check = crc(out, start, length - 2, CRC16)
    out[start + length - 2], out[start + length - 1] = check >> 8, check & 255

    seek = np.zeros(len(row), SEEK)
    seek["sample"], seek["offset"], seek["n"] = number * BLOCK, start - (stream[:-1] + ahead)[row], count
    first, streams, raw = np.cumsum(frames) - frames, [], out.tobytes()
    as_signed = signed.astype(np.int8)
    for i in range(len(size)):
        mine = slice(first[i], first[i] + frames[i])
        info = BLOCK.to_bytes(2) * 2 + int(length[mine].min()).to_bytes(3) + int(length[mine].max()).to_bytes(3)
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | int(size[i])).to_bytes(8) + hashlib.md5(as_signed[offsets[i] : offsets[i + 1]].tobytes()).digest()
        table = seek[mine].tobytes()
        streams.append(b"fLaC" + b"\x00" + len(info).to_bytes(3) + info + b"\x83" + len(table).to_bytes(3) + table + raw[stream[i] + ahead[i] : stream[i + 1]])
    return streams


@dataclass
class Frames:
    """Decoded frames: the samples of all channels, interleaved, and where each frame's samples lie in its stream."""

    row: np.ndarray
    sample: np.ndarray  # first of the frame, in samples of one channel
    count: np.ndarray
    samples: np.ndarray
    offsets: np.ndarray  # of each stream's samples
    channels: np.ndarray
    depth: np.ndarray


def block_size(code: np.ndarray) -> np.ndarray:
    """Samples a frame for the header's codes that need no further bytes."""
    return np.where(code == 1, 192, np.where(code <= 5, 576 << np.maximum(0, code - 2), 256 << np.maximum(0, code - 8)))


class Broken(ValueError):
    """A stream whose structure or check sums are wrong."""


class Unread(ValueError):
    """A stream that may be sound but is of a kind that is not read."""


def need(ok: np.ndarray | bool, what: str) -> None:
    if not np.all(ok):
        raise Broken(what)


@dataclass
class Info:
    """A stream's metadata. ``total`` is 0 where the stream does not say."""

    begin: int
    total: int
    channels: int
    depth: int
    digest: bytes
    seek: np.ndarray


def metadata(stream: bytes) -> Info:
    need(stream[:4] == b"fLaC", "no FLAC stream")
    at, info, seek, last = 4, None, np.zeros(0, SEEK), False
    while not last:
        need(at + 4 <= len(stream), "metadata cut off")
        last, kind, n = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + n]
        need(len(body) == n, "metadata cut off")
        if kind == 0:
            need(n == 34, "broken stream information")
            packed = int.from_bytes(body[10:18])
            info = packed & ((1 << 36) - 1), ((packed >> 41) & 7) + 1, ((packed >> 36) & 31) + 1, body[18:34]
        elif kind == 3:
            need(n % SEEK.itemsize == 0, "a broken seek table")
            seek = np.frombuffer(body, SEEK)
            seek = seek[seek["sample"] != (1 << 64) - 1]
        at += 4 + n
    need(info is not None, "no stream information")
    if not 4 <= info[2] <= 24:
        raise Unread(f"{info[2]} bits a sample")
    return Info(at, *info, seek)


@dataclass
class Heads:
    """Frame headers, and whether each is sound."""

    ok: np.ndarray
    length: np.ndarray
    count: np.ndarray
    layout: np.ndarray  # channels less one, or 8 left and side, 9 side and right, 10 middle and side
    depth: np.ndarray


def headers(data: np.ndarray, start: np.ndarray) -> Heads:
    """The headers that begin at ``start``; ``data`` has sixteen bytes more."""
    lead = data[start + 4]
    used = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, np.where(lead < 0xFC, 5, np.where(lead < 0xFE, 6, 7))))))
    code, rate, layout, depth = data[start + 2] >> 4, data[start + 2] & 15, data[start + 3] >> 4, (data[start + 3] >> 1) & 7
    more = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    length = 4 + used + more + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0)) + 1
    tail = start + 4 + used
    count = np.where(code == 6, data[tail] + 1, np.where(code == 7, (data[tail] << 8 | data[tail + 1]) + 1, block_size(code)))
    ok = (data[start] == 0xFF) & (data[start + 1] & 0xFE == 0xF8) & (code > 0) & (rate < 15) & (layout < 11) & (DEPTHS[depth] >= 0) & (data[start + 3] & 1 == 0)
    ok &= crc(data, start, length - 1, CRC8) == data[start + length - 1]
    return Heads(ok, length, count, layout, DEPTHS[depth])


def whole_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return crc(data, start, end - start - 2, CRC16) == (data[end - 2] << 8 | data[end - 1])


def find_frames(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Where the frames between ``begin`` and ``end`` start: sync codes with a sound header that close a sound frame."""
    at = begin + np.flatnonzero((data[begin : end - 1] == 0xFF) & (data[begin + 1 : end] & 0xFE == 0xF8))
    at = at[headers(data, at).ok]
    need(len(at) > 0 and at[0] == begin, "no frame where the first should be")
    good = whole_frames(data, at, np.r_[at[1:], end])
    starts, k = [], 0
    while k < len(at):
        starts.append(at[k])
        stop = k + 1
        if not good[k]:  # a sync code within the frame
            ends = np.r_[at[k + 1 :], end]
            fits = next((j for j, e in enumerate(ends.tolist()) if whole_frames(data, at[k : k + 1], np.array([e]))[0]), None)
            need(fits is not None, "wrong CRC-16")
            stop = k + 1 + fits
        k = stop
    return np.array(starts)


def decode(streams: list[bytes]) -> Frames:
    """All samples of ``streams``. Raises ``Broken`` on any fault, ``Unread`` on streams of over 24 bits."""
    data = np.frombuffer(b"".join(streams) + b"\0" * 32, np.uint8).astype(np.int64)
    base = np.r_[0, np.cumsum([len(s) for s in streams])]
    parts, meta = [], [metadata(s) for s in streams]
    for i, info in enumerate(meta):
        begin, limit = int(base[i]) + info.begin, int(base[i + 1])
        seek = info.seek
        if len(seek) and seek["offset"][0] == 0 and seek["n"].sum(dtype=np.int64) == info.total:
            at = begin + seek["offset"].astype(np.int64)
            need((np.diff(at) > 0).all() and at[-1] < limit and np.array_equal(seek["sample"], np.r_[0, np.cumsum(seek["n"], dtype=np.uint64)[:-1]]), "a broken seek table")
        else:
            at = find_frames(data, begin, limit) if limit > begin else np.zeros(0, np.int64)
        parts.append((np.full(len(at), i), at, np.r_[at[1:], limit] if len(at) else at))
    row, start, end = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3

    need(end - start > 8, "a frame that does not fit")
    heads = headers(data, start)
    need(heads.ok, "wrong CRC-8 or a broken frame header")
    count, head = heads.count, heads.length
    need(end - start - 2 > head, "a frame that does not fit")
    need(whole_frames(data, start, end), "wrong CRC-16")
    channels, depth = np.array([m.channels for m in meta], np.int64), np.array([m.depth for m in meta], np.int64)
    need(np.where(heads.layout < 8, heads.layout + 1, 2) == channels[row], "another number of channels")
    need((heads.depth == 0) | (heads.depth == depth[row]), "another sample size")
    total = np.bincount(row, weights=count, minlength=len(meta)).astype(np.int64)
    need([m.total in (0, n) for m, n in zip(meta, total.tolist(), strict=True)], "another number of samples")
    before = np.cumsum(count) - count
    sample = before - (np.cumsum(total) - total)[row]
    offsets = np.r_[0, np.cumsum(total * channels)]

    word = sum(data[j : len(data) - 7 + j] << (48 - 8 * j) for j in range(7))  # 56 bits from each byte on

    def take(pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """``n`` bits (49 at most) at bit position ``pos``."""
        return ((word[pos >> 3] << (pos & 7)) & FULL) >> (56 - n)

    pos = (start + head) * 8
    width = int(channels.max(initial=1))
    flat = np.zeros((int(count.sum()), width), np.int64)
    for c in range(width):
        has = np.flatnonzero(channels[row] > c)
        side = (heads.layout[has] == 8) & (c == 1) | (heads.layout[has] == 9) & (c == 0) | (heads.layout[has] == 10) & (c == 1)
        pos[has], flat[np.repeat(before[has] - (np.cumsum(count[has]) - count[has]), count[has]) + np.arange(count[has].sum()), c] = subframes(take, word, pos[has], count[has], depth[row][has] + side)
    need((pos + 7 >> 3) + 2 == end, "a frame ends elsewhere")
    layout = np.repeat(heads.layout, count)
    if width > 1:
        a, b = flat[:, 0].copy(), flat[:, 1].copy()
        middle = a << 1 | b & 1
        flat[:, 0] = np.where(layout == 9, a + b, np.where(layout == 10, (middle + b) >> 1, a))
        flat[:, 1] = np.where(layout == 8, a - b, np.where(layout == 10, (middle - b) >> 1, b))
    own = np.repeat(channels[row], count)
    samples = flat[np.arange(width) < own[:, None]]
    for i, info in enumerate(meta):
        if any(info.digest):
            size = -(-info.depth // 8)
            raw = samples[offsets[i] : offsets[i + 1]].astype("<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes()
            need(hashlib.md5(raw).digest() == info.digest, "wrong MD5")
    return Frames(row, sample, count, samples, offsets, channels, depth)


FULL = (1 << 56) - 1


def signed(x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return x - ((x >> (n - 1)) << n)


def subframes(take, word: np.ndarray, pos: np.ndarray, count: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """One subframe of each frame: where it ends, and all samples, one frame after the other."""
    need(take(pos, 1) == 0, "a bad subframe")
    kind, wasted = take(pos + 1, 6), take(pos + 7, 1)
    pos = pos + 8
    if wasted.any():
        more = np.where(wasted > 0, ZEROS[take(pos, 16)] + 1, 0)
        need(more < np.minimum(depth, 17), "too many wasted bits")
        pos, wasted = pos + more, more
    depth = depth - wasted
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)

    own = np.flatnonzero(kind == 0)
    if len(own):
        out[np.repeat(place[own] - (np.cumsum(count[own]) - count[own]), count[own]) + np.arange(count[own].sum())] = np.repeat(signed(take(pos[own], depth[own]), depth[own]), count[own])
        pos[own] += depth[own]
    own = np.flatnonzero(kind == 1)
    for n in np.unique(count[own]):
        some = own[count[own] == n]
        wide = depth[some][:, None]
        out[place[some][:, None] + np.arange(n)] = signed(take(pos[some][:, None] + wide * np.arange(n), wide), wide)
        pos[some] += depth[some] * n
    for n, what in sorted(set(zip(count[kind > 1].tolist(), kind[kind > 1].tolist(), strict=True))):
        some = np.flatnonzero((count == n) & (kind == what))
        need(8 <= what <= 12 or what >= 32, "reserved subframe")
        order = what - 8 if what < 32 else what - 31
        need(order <= n, "a predictor longer than its frame")
        p, wide = pos[some], depth[some][:, None]
        warm = signed(take(p[:, None] + wide * np.arange(order), wide), wide)
        p = p + depth[some] * order
        if what >= 32:
            precision, shift = take(p, 4) + 1, signed(take(p + 4, 5), 5)
            need((precision < 16) & (shift >= 0), "a reserved predictor")
            factors = signed(take((p + 9)[:, None] + precision[:, None] * np.arange(order), precision[:, None]), precision[:, None])
            p = p + 9 + precision * order
        r, p = residuals(take, word, p, n, order)
        pos[some] = p
        if what < 32:
            r = integrated(warm, r)
        else:
            back, r = np.ascontiguousarray(factors.T[::-1]), np.concatenate([warm.T, r.T])  # a row for each sample
            for i in range(order, n):
                r[i] += (back * r[i - order : i]).sum(0) >> shift
            r = r.T
        out[place[some][:, None] + np.arange(n)] = r
    return pos, out << np.repeat(wasted, count)


def residuals(take, word: np.ndarray, pos: np.ndarray, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Rice-coded residuals of frames of ``n`` samples, sample by sample over all frames."""
    method, parts = take(pos, 2), take(pos + 2, 4)
    need(method < 2, "reserved residual coding")
    pos = pos + 6
    wide = 4 + method
    out = np.zeros((len(pos), n - order), np.int64)
    k, raw, escaped = np.zeros_like(pos), np.zeros_like(pos), np.zeros(len(pos), bool)
    per = n >> parts
    splits = {0} | {int(i) - order for s in np.unique(per) if s < n for i in range(s, n, s)}
    for i in range(n - order):
        if i in splits:
            new = (i == 0) | ((i + order) % per == 0)
            k = np.where(new, take(pos, wide), k)
            pos = pos + np.where(new, wide, 0)
            escaped = np.where(new, k == (1 << wide) - 1, escaped)
            if escaped.any():
                raw = np.where(new & escaped, take(pos, 5), raw)
                pos = pos + np.where(new & escaped, 5, 0)
        q = ZEROS[((word[pos >> 3] << (pos & 7)) >> 40) & 0xFFFF]
        if escaped.any():
            q = np.where(escaped, 0, q)
        far = q == 16
        while far.any():  # longer runs of zeros
            at = pos + q
            need(at >> 3 < len(word), "a residual without an end")
            step = np.where(far, ZEROS[((word[at >> 3] << (at & 7)) >> 40) & 0xFFFF], 0)
            q = q + step
            far = step == 16
        after = pos + q + 1
        z = q << k | take(after, k)
        value = (z >> 1) ^ -(z & 1)
        pos_next = after + k
        if escaped.any():
            x = take(pos, np.maximum(raw, 1))
            value = np.where(escaped, np.where(raw > 0, x - ((x >> (np.maximum(raw, 1) - 1)) << np.maximum(raw, 1)), 0), value)
            pos_next = np.where(escaped, pos + raw, pos_next)
        out[:, i], pos = value, pos_next
    return out, pos


def integrated(warm: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Samples from the residuals of a fixed predictor, whose order is the number of warm-up samples."""
    starts, d = [], warm
    while d.shape[1]:
        starts.append(d[:, :1])
        d = np.diff(d, axis=1)
    for first in reversed(starts):
        r = np.cumsum(np.concatenate([first, r], 1), 1)
    return r
