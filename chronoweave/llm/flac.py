"""FLAC: 8-bit mono streams written and read with numpy, all frames of a slab at once."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np

#: Samples of a frame, frames handled at once, and frames between two seek points.
BLOCK, SLAB, SEEK_EVERY = 192, 2048, 64
RATE = 8000
LPC_ORDER, LPC_PRECISION = 2, 10

# Fixed values of the format: predictor coefficients, frame header for 192 samples at 8 kHz, mono, 8 bits.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
HEAD = bytes([0xFF, 0xF8, 0x14, 0x02])
CRC8_POLYNOMIAL, CRC16_POLYNOMIAL = 0x07, 0x8005


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, full = 1 << (bits - 1), (1 << bits) - 1
    crc = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        crc = np.where(crc & top, (crc << 1) ^ polynomial, crc << 1) & full
    return crc.astype(np.int32)


_CRC8, _CRC16 = _crc_table(CRC8_POLYNOMIAL, 8), _crc_table(CRC16_POLYNOMIAL, 16)


class FlacError(ValueError):
    """A stream that is not FLAC, not of the kind written here, or damaged."""


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(_CRC8[crc ^ b])
    return crc


def crc16s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each stretch of data, one byte of all of them at a time."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, crc = starts[order], np.zeros(len(sizes), dtype=np.int32)
    live = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    for i, n in enumerate(live.tolist()):
        c = crc[:n]
        crc[:n] = _CRC16[(c >> 8) ^ data[at[:n] + i]] ^ ((c << 8) & 0xFFFF)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: int) -> bytes:
    """A frame number in the format's extension of UTF-8, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (6 * k + (6 - k if k < 6 else 0)))
    lead = (0xFF00 >> (more + 1)) & 0xFF
    return bytes([lead | (n >> (6 * more)), *(0x80 | (n >> (6 * i)) & 0x3F for i in reversed(range(more)))])


def _number_at(data: bytes, at: int) -> tuple[int, int]:
    """A coded number and where it ends."""
    lead = data[at]
    if lead < 0x80:
        return lead, at + 1
    more = next((k for k in range(1, 7) if lead & (0x40 >> k) == 0), 7) if lead != 0xFE else 6
    if lead < 0xC0 or more > 6:
        raise FlacError("bad frame number")
    n = lead & (0x3F >> more)
    for b in data[at + 1 : at + 1 + more]:
        n = n << 6 | b & 0x3F
    return n, at + 1 + more


def _lpc(x: np.ndarray, order: int, precision: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, order) and shifts, by Levinson-Durbin on each frame's autocorrelation."""
    w = x.astype(np.float64)
    r = np.stack([(w[:, : w.shape[1] - k] * w[:, k:]).sum(axis=1) for k in range(order + 1)], axis=1)
    a, error = np.zeros((len(x), order)), r[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = error * np.maximum(1 - k * k, 1e-9)
    most = np.abs(a).max(axis=1)
    shift = np.clip(precision - 2 - np.floor(np.log2(np.maximum(most, 1e-6))).astype(np.int64), 0, 15)
    limit = (1 << (precision - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int32), shift.astype(np.int32)


def _residual_cost(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of residuals (frames, n): their codes' numbers, the best Rice parameter and bits, tried around the mean's."""
    u = (r << 1) ^ (r >> 31)
    n = u.shape[1]
    guess = np.floor(np.log2(np.maximum(u.mean(axis=1) * 0.6931, 1))).astype(np.int32)
    best = np.full(len(u), np.iinfo(np.int32).max, dtype=np.int64)
    k = guess
    for tried in (guess, guess + 1):
        bits = (u >> tried[:, None]).sum(axis=1) + n * (tried + 1)
        k = np.where(bits < best, tried, k)
        best = np.minimum(bits, best)
    return u, np.minimum(k, 14).astype(np.int32), best


def encode_frames(x: np.ndarray, numbers: np.ndarray, lpc_order: int = LPC_ORDER) -> list[bytes]:
    """One frame for each row of x (signed samples, 192 a row): constant, verbatim, fixed or linear prediction, whichever is least."""
    x = x.astype(np.int32)
    count = len(x)
    tried = []
    r = x
    for order in range(5):
        if order:
            r = np.diff(r, axis=1)
        u, k, bits = _residual_cost(r)
        tried.append((order, u, k, bits + 8 * order + 10, 8 + order, None))
    if lpc_order:
        a, shift = _lpc(x, lpc_order, LPC_PRECISION)
        guess = sum(a[:, j : j + 1] * x[:, lpc_order - 1 - j : BLOCK - 1 - j] for j in range(lpc_order)) >> shift[:, None]
        u, k, bits = _residual_cost(x[:, lpc_order:] - guess)
        tried.append((lpc_order, u, k, bits + lpc_order * (8 + LPC_PRECISION) + 19, 31 + lpc_order, (a, shift)))
    costs = np.stack([t[3] for t in tried] + [np.full(count, 8 * BLOCK)], axis=1)
    kind = costs.argmin(axis=1)
    constant = (x == x[:, :1]).all(axis=1)
    kind[constant] = len(tried) + 1
    body = np.where(constant, 8, costs.min(axis=1)) + 8
    heads = [HEAD + coded_number(int(n)) for n in numbers]
    heads = [h + bytes([crc8(h)]) for h in heads]
    head_sizes = np.array([len(h) for h in heads], dtype=np.int64)
    sizes = head_sizes + (body + 7) // 8 + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    bits = np.zeros(8 * int(ends[-1]), dtype=np.uint8)

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[at + b] = (value >> (width - 1 - b)) & 1

    first = 8 * (starts + head_sizes)
    for which, (order, u, k, _, code, lpc) in enumerate(tried):
        rows = np.flatnonzero(kind == which)
        if not len(rows):
            continue
        at = first[rows]
        put(at, np.full(len(rows), code << 1), 8)
        at = at + 8
        for i in range(order):
            put(at, x[rows, i] & 0xFF, 8)
            at = at + 8
        if lpc:
            put(at, np.full(len(rows), LPC_PRECISION - 1), 4)
            put(at + 4, lpc[1][rows], 5)
            at = at + 9
            for j in range(order):
                put(at, lpc[0][rows, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
                at = at + LPC_PRECISION
        k = k[rows]
        put(at + 6, k, 4)  # before it: coding method and partition order, both 0
        u = u[rows]
        q = u >> k[:, None]
        widths = q + (k + 1)[:, None]
        stop = (at + 10)[:, None] + np.cumsum(widths, axis=1) - k[:, None] - 1
        bits[stop] = 1
        for width in np.unique(k).tolist():
            same = k == width
            below, low = stop[same] + 1, u[same]
            for b in range(width):
                bits[below + b] = (low >> (width - 1 - b)) & 1
    rows = np.flatnonzero(kind == len(tried))
    if len(rows):
        put(first[rows], np.full(len(rows), 1 << 1), 8)
        bits[(first[rows] + 8)[:, None] + np.arange(8 * BLOCK)] = np.unpackbits((x[rows] & 0xFF).astype(np.uint8), axis=1)
    rows = np.flatnonzero(constant)
    if len(rows):
        put(first[rows] + 8, x[rows, 0] & 0xFF, 8)
    data = np.packbits(bits)
    flat = np.frombuffer(b"".join(heads), dtype=np.uint8)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(head_sizes) - head_sizes, head_sizes)
    data[at + np.repeat(starts, head_sizes)] = flat
    crc = crc16s(data, starts, ends - 2)
    data[ends - 2], data[ends - 1] = crc >> 8, crc & 0xFF
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def assemble(frames: list[bytes], payload: bytes) -> bytes:
    """A stream of the payload's frames: marker, stream information, seek table, frames. payload: unsigned samples."""
    sizes = [len(f) for f in frames]
    signed = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += ((RATE << 44) | (7 << 36) | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    points, offset = [], 0
    for n, size in enumerate(sizes):
        if n % SEEK_EVERY == 0:
            points.append(struct.pack(">QQH", n * BLOCK, offset, BLOCK))
        offset += size
    table = b"".join(points)
    return b"".join([b"fLaC", b"\x00" + len(info).to_bytes(3, "big"), info, b"\x83" + len(table).to_bytes(3, "big"), table, *frames])


def encode(payloads: list[bytes], lpc_order: int = LPC_ORDER) -> Iterator[bytes]:
    """A stream for each payload, whose length must be a positive multiple of 192; frames of many are coded together."""
    for group in _grouped(payloads, SLAB * BLOCK):
        x = np.frombuffer(b"".join(group), dtype=np.uint8).reshape(-1, BLOCK).astype(np.int32) - 128
        counts = [len(p) // BLOCK for p in group]
        numbers = np.concatenate([np.arange(c) for c in counts])
        frames: list[bytes] = []
        for at in range(0, len(x), SLAB):
            frames += encode_frames(x[at : at + SLAB], numbers[at : at + SLAB], lpc_order)
        at = 0
        for payload, c in zip(group, counts, strict=True):
            yield assemble(frames[at : at + c], payload)
            at += c


def _grouped(items: list[bytes], most: int) -> Iterator[list[bytes]]:
    group, held = [], 0
    for item in items:
        if group and held + len(item) > most:
            yield group
            group, held = [], 0
        group.append(item)
        held += len(item)
    if group:
        yield group


def stream_info(media: bytes) -> dict:
    """The metadata: samples, md5, where the frames begin, and the seek points (sample, offset from the first frame)."""
    if media[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, out, last = 4, {"seek": []}, False
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        block = media[at + 4 : at + 4 + size]
        at += 4 + size
        if len(block) < size:
            raise FlacError("the metadata breaks off")
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            out |= {"block": struct.unpack(">H", block[:2])[0], "samples": packed & ((1 << 36) - 1), "bits": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "md5": block[18:34]}
        elif kind == 3:
            out["seek"] = [(s, o) for s, o, n in struct.iter_unpack(">QQH", block) if s != (1 << 64) - 1]
    if "md5" not in out or (out["bits"], out["channels"]) != (8, 1):
        raise FlacError("not an 8-bit mono stream")
    return out | {"first": at}


def frame_starts(media: bytes, first: int, number: int = 0) -> tuple[list[int], list[int]]:
    """Starts and header sizes of the frames from `first` on, told by sync code, header checksum and running number."""
    starts, sizes, at = [], [], first
    while at < len(media):
        if media[at : at + 4] == HEAD and at + 6 <= len(media):
            n, end = _number_at(media, at + 4)
            if n == number and end < len(media) and crc8(media[at:end]) == media[end]:
                starts.append(at)
                sizes.append(end + 1 - at)
                number += 1
        elif not starts:
            raise FlacError("no frame where one should begin")
        at = media.find(HEAD, at + 1)
        if at < 0:
            break
    return starts, sizes


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Signed samples (frames, block) after each frame's CRC-16 is verified; sample by sample over all frames at once."""
    stored = (data[ends - 2].astype(np.int32) << 8) | data[ends - 1]
    if not np.array_equal(crc16s(data, starts, ends - 2), stored):
        raise FlacError("a frame's checksum does not match")
    count = len(starts)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    word = sum(padded[i : len(padded) - 7 + i] << np.uint64(8 * (7 - i)) for i in range(8))
    bits = np.unpackbits(data)
    ones = np.append(np.flatnonzero(bits), 8 * len(data))
    before = np.cumsum(bits, dtype=np.int32) - bits
    before = np.append(before, np.full(64, before[-1] if len(before) else 0, dtype=np.int32))

    def read(at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        w = np.asarray(width).astype(np.uint64)
        left = word[at >> 3] << (at & 7).astype(np.uint64)
        return np.where(w > 0, left >> ((np.uint64(64) - w) & np.uint64(63)), np.uint64(0)).astype(np.int64)

    def signed(v: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return v - ((v >> (np.maximum(width, 1) - 1) & 1) << width)

    at = 8 * (starts + heads)
    code = read(at, 8) >> 1
    at = at + 8
    constant, verbatim = code == 0, code == 1
    is_fixed, is_lpc = (code >= 8) & (code <= 12), code >= 32
    if not (constant | verbatim | is_fixed | is_lpc).all():
        raise FlacError("unknown subframe")
    order = np.where(is_fixed, code - 8, np.where(is_lpc, code - 31, 0))
    coded = is_fixed | is_lpc
    x = np.zeros((count, block), dtype=np.int64)
    x[constant] = signed(read(at[constant], 8), 8)[:, None]
    raw = np.flatnonzero(verbatim)
    if len(raw):
        x[raw] = data[(at[raw] >> 3)[:, None] + np.arange(block)].astype(np.int8)
    lanes = np.flatnonzero(coded)
    if not len(lanes):
        return x
    at, order = at[lanes], order[lanes]
    deepest = int(order.max())
    weights, shift = np.zeros((len(lanes), deepest), dtype=np.int64), np.zeros(len(lanes), dtype=np.int64)
    y = np.zeros((block, len(lanes)), dtype=np.int64)
    for i in range(deepest):
        warm = order > i
        y[i, warm] = signed(read(at[warm] + 8 * i, 8), 8)
    at = at + 8 * order
    for o, w in FIXED.items():
        weights[np.flatnonzero(is_fixed[lanes] & (order == o))[:, None], np.arange(o)] = w
    rows = np.flatnonzero(is_lpc[lanes])
    if len(rows):
        precision = read(at[rows], 4) + 1
        shift[rows] = read(at[rows] + 4, 5)
        at[rows] += 9
        for j in range(deepest):
            some = rows[order[rows] > j]
            p = precision[order[rows] > j]
            weights[some, j] = signed(read(at[some], p), p)
            at[some] += p
    method = read(at, 2)
    if (method > 1).any():
        raise FlacError("unknown residual coding")
    param_bits, part = 4 + method, block >> read(at + 2, 4)
    at = at + 6
    k, plain = np.zeros(len(lanes), dtype=np.int64), np.full(len(lanes), -1, dtype=np.int64)
    turns = weights.T.copy()
    for i in range(block):
        new = (i >= order) & ((i == order) | (i % part == 0))
        if new.any():
            fresh = np.flatnonzero(new)
            k[fresh] = read(at[fresh], param_bits[fresh])
            at[fresh] += param_bits[fresh]
            plain[fresh] = -1
            escaped = fresh[k[fresh] == (1 << param_bits[fresh]) - 1]
            if len(escaped):
                plain[escaped] = read(at[escaped], 5)
                at[escaped] += 5
                k[escaped] = 0
        stop = ones[before[at]]
        u = ((stop - at) << k) | read(stop + 1, k)
        residual = (u >> 1) ^ -(u & 1)
        onward = stop + 1 + k
        if (plain >= 0).any():
            residual = np.where(plain >= 0, np.where(plain > 0, signed(read(at, np.maximum(plain, 0)), np.maximum(plain, 1)), 0), residual)
            onward = np.where(plain >= 0, at + plain, onward)
        guess = np.zeros(len(lanes), dtype=np.int64)
        for j in range(min(i, deepest)):
            guess += turns[j] * y[i - 1 - j]
        live = i >= order
        y[i] = np.where(live, (guess >> shift) + residual, y[i])
        at = np.where(live, onward, at)
    x[lanes] = y.T
    return x


def decode(medias: list[bytes]) -> Iterator[bytes]:
    """The unsigned samples of each stream; frame checksums, sample count and MD5 are verified."""
    for group in _grouped(medias, SLAB * BLOCK):
        data = b"".join(group)
        starts, heads, ends, counts, infos, base = [], [], [], [], [], 0
        for media in group:
            info = stream_info(media)
            if info["block"] != BLOCK or info["samples"] % BLOCK:
                raise FlacError("not a stream of whole frames of 192 samples")
            s, h = frame_starts(media, info["first"])
            starts += [base + a for a in s]
            ends += [base + a for a in [*s[1:], len(media)]]
            heads += h
            counts.append(len(s))
            infos.append(info)
            base += len(media)
        buffer = np.frombuffer(data, dtype=np.uint8)
        out: list[np.ndarray] = []
        a, b, h = np.array(starts), np.array(ends), np.array(heads)
        for at in range(0, len(a), SLAB):
            low, high = int(a[at]), int(b[min(at + SLAB, len(a)) - 1])
            sl = slice(at, at + SLAB)
            out.append((decode_frames(buffer[low:high], a[sl] - low, b[sl] - low, h[sl]) + 128).astype(np.uint8))
        samples = np.concatenate(out).reshape(-1)
        at = 0
        for info, c in zip(infos, counts, strict=True):
            own = samples[at * BLOCK : (at + c) * BLOCK]
            at += c
            if len(own) != info["samples"] or hashlib.md5((own ^ 0x80).tobytes()).digest() != info["md5"]:
                raise FlacError("the samples do not match the stream's MD5")
            yield own.tobytes()


def attempt(media: bytes) -> tuple[bytes | None, str | None]:
    """A stream's samples, or what is wrong with it; lengths and offsets of a damaged one can lead anywhere."""
    try:
        return next(decode([media])), None
    except (FlacError, IndexError, ValueError, OverflowError, StopIteration) as wrong:
        return None, str(wrong) or type(wrong).__name__


def decode_from(media: bytes, sample: int) -> bytes:
    """The unsigned samples from `sample` on, read from the seek point at or before it instead of from the start."""
    info = stream_info(media)
    at, offset = max(((s, o) for s, o in info["seek"] if s <= sample), default=(0, 0))
    starts, heads = frame_starts(media, info["first"] + offset, at // BLOCK)
    ends = [*starts[1:], len(media)]
    x = decode_frames(np.frombuffer(media, dtype=np.uint8), np.array(starts), np.array(ends), np.array(heads))
    return (x + 128).astype(np.uint8).reshape(-1)[sample - at :].tobytes()
