"""FLAC streams of 8-bit mono samples: encoder, decoder and seekable PCM blocks, over many streams at once.

Frames of a batch are coded and decoded in lock step: step i handles sample (or bit field, or byte) i of
every frame with one numpy operation, so the cost for each sample is that of an array element.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, quoted, slices, texts

#: Fixed values of the format.
RATE, BITS, BLOCK = 8000, 8, 4096
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
RICE_PARTS, RICE_ESCAPE = 4, 15


def _crc_table(poly: int, bits: int, chunk: int) -> np.ndarray:
    """Remainders of all values of ``chunk`` leading bits."""
    reg = np.arange(1 << chunk, dtype=np.int64) << (bits - chunk)
    mask, top = (1 << bits) - 1, 1 << (bits - 1)
    for _ in range(chunk):
        reg = np.where(reg & top, (reg << 1) ^ poly, reg << 1) & mask
    return reg


_CRC8, _CRC16, _CRC16_WORD = _crc_table(0x07, 8, 8), _crc_table(0x8005, 16, 8), _crc_table(0x8005, 16, 16)


def crc8(data: bytes) -> int:
    reg = 0
    for b in data:
        reg = int(_CRC8[reg ^ b])
    return reg


def crc16(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of the first ``size`` bytes of each row; rows sorted by falling size."""
    reg = np.zeros(len(size), np.int64)
    words = rows[:, : rows.shape[1] // 2 * 2].reshape(len(rows), -1, 2).astype(np.int64)
    words = np.ascontiguousarray((words[:, :, 0] << 8 | words[:, :, 1]).T)
    pairs = size // 2
    more = np.searchsorted(-pairs, -np.arange(int(pairs[0]) if len(pairs) else 0), side="left").tolist()
    for i, n in enumerate(more):  # n rows have more than i pairs
        reg[:n] = _CRC16_WORD[reg[:n] ^ words[i, :n]]
    odd = size % 2 == 1
    last = rows[np.arange(len(size)), np.maximum(size - 1, 0)].astype(np.int64)
    return np.where(odd, ((reg << 8) & 0xFFFF) ^ _CRC16[(reg >> 8) ^ last], reg)


def utf8_number(n: int) -> bytes:
    """A frame number as the format codes it (UTF-8's scheme, up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    tail = 1
    while n >= 1 << (6 * tail + 6 - tail):
        tail += 1
    out = [0x80 | n >> 6 * i & 0x3F for i in reversed(range(tail))]
    return bytes([(0xFF << (7 - tail)) & 0xFF | n >> 6 * tail, *out])


def header(number: int, samples: int) -> bytes:
    """A frame's header: fixed block size, 8 kHz, mono, 8 bits; the block size spelt out as 16 bits."""
    head = b"\xff\xf8" + bytes([0x74, 0x02]) + utf8_number(number) + (samples - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _fields(values: list[np.ndarray], widths: list[np.ndarray]) -> np.ndarray:
    """Bits of each row's fields, one after the other: uint8 rows of zero-padded bytes.

    ``values`` and ``widths`` are matrices (rows x fields); a width may exceed 57 bits if the value is small.
    """
    value, width = np.concatenate(values, axis=1), np.concatenate(widths, axis=1)
    ends = np.cumsum(width, axis=1)
    total = int(ends[:, -1].max())
    cols = (total + 7) // 8 + 8
    out = np.zeros((len(value), cols), np.uint8)
    flat = out.ravel()
    row = np.arange(len(value))[:, None] * cols
    # the last bit of a field is at ends - 1; write its (at most 25) significant bits as up to 4 bytes
    shift = (-ends) & 7
    moved = value.astype(np.int64) << shift
    last = row + (ends - 1) // 8
    live = width > 0
    for k in range(4):
        part = ((moved >> 8 * k) & 0xFF).astype(np.uint8)
        some = live & (part > 0)
        # fields of a row share bytes at their edges only, and no bit twice: add is or
        np.add.at(flat, (last - k)[some], part[some])
    return out[:, : cols - 8]


def encode_frames(blocks: list[np.ndarray], numbers: list[int]) -> list[bytes]:
    """FLAC frames of blocks of int8 samples (1 to 65,535 in each).

    Each frame takes the fixed predictor with the smallest sum of residuals and Rice parameters of up to 16
    partitions; constant and verbatim subframes where they are smaller.
    """
    done: list[bytes | None] = [None] * len(blocks)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, b in enumerate(blocks):
        if len(b) < 16 or (b == b[0]).all():
            kind = b"\x00" + b[:1].tobytes() if (b == b[0]).all() else b"\x02" + b.tobytes()
            done[i] = header(numbers[i], len(b)) + kind
        else:
            groups.setdefault((len(b), 0), []).append(i)
    for (n, _), rows in groups.items():
        for at in range(0, len(rows), max(1, (1 << 19) // n)):
            some = rows[at : at + max(1, (1 << 19) // n)]
            for i, frame in zip(some, _encode_group(np.stack([blocks[i] for i in some]), [numbers[i] for i in some]), strict=True):
                done[i] = frame
    return [f + c.to_bytes(2, "big") for f, c in zip(done, crc16_each(done), strict=True)]


def crc16_each(frames: list[bytes]) -> list[int]:
    """CRC-16 of each byte string; a megabyte of them at a time."""
    out = [0] * len(frames)
    order, at = sorted(range(len(frames)), key=lambda i: -len(frames[i])), 0
    while at < len(order):
        width = len(frames[order[at]])
        some = order[at : at + max(1, (1 << 20) // width)]
        grid = np.frombuffer(b"".join(frames[i].ljust(width + 1, b"\0") for i in some), np.uint8).reshape(len(some), width + 1)
        for i, c in zip(some, crc16(grid, np.array([len(frames[i]) for i in some])).tolist(), strict=True):
            out[i] = c
        at += len(some)
    return out


def _encode_group(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    m, n = x.shape
    wide = x.astype(np.int32)
    residual, best, order = wide, np.abs(wide).sum(axis=1), np.zeros(m, np.int64)
    kept = wide.copy()
    for k in range(1, 5):
        residual = np.diff(residual, axis=1)
        cost = np.abs(residual).sum(axis=1)
        take = cost < best
        best, order = np.where(take, cost, best), np.where(take, k, order)
        kept[take, k:] = residual[take]
    out: list[bytes] = [b""] * m
    level = max(p for p in range(RICE_PARTS + 1) if n % (1 << p) == 0 and n >> p >= 8 or p == 0)
    part = n >> level
    for k in np.unique(order).tolist():
        rows = np.flatnonzero(order == k)
        r = kept[rows]
        zig = (r << 1) ^ (r >> 31)
        zig[:, :k] = 0
        sums = zig.reshape(len(rows), 1 << level, part).sum(axis=2)
        size = np.full(1 << level, part)
        size[0] -= k
        mean = sums / np.maximum(size, 1)
        rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))), 0, 14).astype(np.int64)
        param = np.repeat(rice, part, axis=1)
        q = zig >> param
        fields_v, fields_w = [], []
        # subframe header; warm-up samples; residual method and partition order
        one = np.ones((len(rows), 1), np.int64)
        fields_v.append(one * ((8 + k) << 1))
        fields_w.append(one * 8)
        fields_v.append(x[rows][:, :k].astype(np.int64) & 0xFF)
        fields_w.append(np.full((len(rows), k), 8))
        fields_v.append(one * level)
        fields_w.append(one * 6)
        for p in range(1 << level):
            a, b = max(p * part, k), (p + 1) * part
            fields_v.append(rice[:, p : p + 1])
            fields_w.append(one * 4)
            low = zig[:, a:b] & ((1 << param[:, a:b]) - 1)
            fields_v.append((1 << param[:, a:b]) | low)
            fields_w.append(q[:, a:b] + 1 + param[:, a:b])
        bits = np.concatenate(fields_w, axis=1).sum(axis=1)
        body = _fields(fields_v, fields_w)
        plain = bits > 8 * n + 8
        for j, i in enumerate(rows.tolist()):
            inner = b"\x02" + x[i].tobytes() if plain[j] else body[j, : (int(bits[j]) + 7) // 8].tobytes()
            out[i] = header(numbers[i], n) + inner
    return out


def stream(frames: list[bytes], sizes: list[int], samples: np.ndarray) -> bytes:
    """A whole stream: STREAMINFO, a SEEKTABLE with each frame's first sample and byte offset, the frames."""
    lengths = [len(f) for f in frames]
    info = max(sizes).to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | (BITS - 1) << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(samples.tobytes()).digest()
    seek, first, offset = b"", 0, 0
    for n, size in zip(sizes, lengths, strict=True):
        seek += first.to_bytes(8, "big") + offset.to_bytes(8, "big") + n.to_bytes(2, "big")
        first, offset = first + n, offset + size
    meta = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
    return b"fLaC" + meta + b"".join(frames)


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """FLAC streams of byte strings (one byte at least), each byte as the sample byte - 128."""
    samples = [(np.frombuffer(p, np.uint8) ^ 0x80).view(np.int8) for p in payloads]
    cuts = [[s[i : i + block] for i in range(0, len(s), block)] for s in samples]
    frames = encode_frames([b for c in cuts for b in c], [i for c in cuts for i in range(len(c))])
    out, at = [], 0
    for s, c in zip(samples, cuts, strict=True):
        out.append(stream(frames[at : at + len(c)], [len(b) for b in c], s))
        at += len(c)
    return out


class Corrupt(ValueError):
    """A stream that breaks the format or fails a checksum."""


def metadata(data: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """STREAMINFO, the seek points (first sample, byte offset, samples; no placeholders), and where the frames begin."""
    if data[:4] != b"fLaC":
        raise Corrupt("no fLaC marker")
    at, info, seek, last = 4, None, [], 0
    while not last:
        if at + 4 > len(data):
            raise Corrupt("metadata is cut off")
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if len(body) < size or kind == 0 and size < 34:
            raise Corrupt("metadata is cut off")
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size // 18 * 18, 18)]
            seek = [x for x in points if x[0] < (1 << 64) - 1]
    if info is None:
        raise Corrupt("no STREAMINFO")
    return info, seek, at


def frame_header(data: bytes, at: int) -> tuple[int, int, int]:
    """Frame (or first sample's) number, samples and the first byte after the header of an 8-bit mono frame."""
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise Corrupt("no frame where one should begin")
    size, rate, lead = head[2] >> 4, head[2] & 15, head[4]
    if head[3] >> 4 or head[3] >> 1 & 7 not in (0, 1):
        raise Corrupt("only one channel of 8 bits is supported")
    tail = max(0, 7 - (lead ^ 0xFF).bit_length())
    if head[3] & 1 or size == 0 or rate == 15 or lead == 0xFF or lead >= 0x80 and tail == 0:
        raise Corrupt("a frame header with reserved values")
    number, p = lead & ((1 << (6 - tail)) - 1) if tail else lead, 5
    for byte in head[5 : 5 + tail]:
        number, p = number << 6 | byte & 0x3F, p + 1
    spelt = {6: 1, 7: 2}.get(size, 0)
    if spelt:
        n = int.from_bytes(head[p : p + spelt], "big") + 1
    else:
        n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    p += spelt + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(head):
        raise Corrupt("a frame header is cut off")
    if crc8(head[:p]) != head[p]:
        raise Corrupt("a frame header's CRC-8 differs")
    return number, n, at + p + 1


def frame_table(data: bytes) -> tuple[dict, list[tuple[int, int, int, int]]]:
    """STREAMINFO, and of each frame its first sample, its samples, and where its bytes begin and end.

    A seek table that names every frame is taken at its word (decoding verifies it); without one, frames are
    found by their sync codes and both checksums.
    """
    info, seek, at = metadata(data)
    if info["channels"] != 1 or info["bits"] != BITS:
        raise Corrupt("only one channel of 8 bits is supported")
    firsts = [x for x, _, _ in seek]
    if seek and firsts[0] == 0 == seek[0][1] and [x + n for x, _, n in seek] == [*firsts[1:], info["samples"]]:
        ends = [o for _, o, _ in seek[1:]] + [len(data) - at]
        return info, [(x, n, at + o, at + e) for (x, o, n), e in zip(seek, ends, strict=True)]
    out, first = [], 0
    while at < len(data):
        n, end = frame_header(data, at)[1], at + 2
        while True:
            end = data.find(b"\xff", end + 1)
            if end < 0:
                end = len(data)
            elif end + 1 >= len(data) or data[end + 1] & 0xFE != 0xF8:
                continue
            if crc16_each([data[at : end - 2]])[0] == int.from_bytes(data[end - 2 : end], "big"):
                break
            if end == len(data):
                raise Corrupt("a frame's CRC-16 differs")
        out.append((first, n, at, end))
        first, at = first + n, end
    return info, out


def plain_frame(frame: bytes) -> np.ndarray:
    """Samples of one frame, read bit by bit: for what the lock-step decoder leaves (wasted bits, 5-bit parameters)."""
    _, n, p = frame_header(frame, 0)
    bits = "".join(f"{b:08b}" for b in frame[p:-2])
    at = 0

    def take(width: int) -> int:
        nonlocal at
        at += width
        if at > len(bits):
            raise Corrupt("a frame is cut off")
        return int(bits[at - width : at], 2) if width else 0

    def signed(width: int) -> int:
        v = take(width)
        return v - (1 << width) if width and v >> (width - 1) else v

    def unary() -> int:
        nonlocal at
        stop = bits.find("1", at)
        if stop < 0:
            raise Corrupt("a frame is cut off")
        zeros, at = stop - at, stop + 1
        return zeros

    zero, kind, wasted = take(1), take(6), take(1)
    wasted = 1 + unary() if wasted else 0
    depth = BITS - wasted
    if zero or depth < 1:
        raise Corrupt("a subframe header with reserved values")
    if kind == 0:
        out = [signed(depth)] * n
    elif kind == 1:
        out = [signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [signed(depth) for _ in range(order)]
        weights, scale = FIXED.get(kind - 8, ()), 0
        if kind >= 32:
            precision, scale = take(4) + 1, signed(5)
            weights = [signed(precision) for _ in range(order)]
        method, level = take(2), take(4)
        if method > 1 or n % (1 << level) or n >> level < order or scale < 0:
            raise Corrupt("residuals with reserved values")
        width = 4 + method
        for part in range(1 << level):
            rice = take(width)
            raw = take(5) if rice == (1 << width) - 1 else None
            for _ in range((n >> level) - (0 if part else order)):
                if raw is not None:
                    v = signed(raw)
                else:
                    v = unary() << rice | take(rice)
                    v = (v >> 1) ^ -(v & 1)
                out.append(v + (sum(w * x for w, x in zip(weights, reversed(out[-len(weights) :] if weights else []), strict=True)) >> scale))
    else:
        raise Corrupt("a subframe of an unknown kind")
    return (np.array(out, np.int64) << wasted).astype(np.int8)


def unusual(frame: bytes, p: int) -> bool:
    """Whether a subframe has wasted bits or Rice parameters of another width than 4."""
    kind, at = frame[p] >> 1 & 0x3F, 8 * (p + 1)
    if frame[p] & 1:
        return True
    if kind >= 32:
        at += BITS * (kind - 31)
        precision = (int.from_bytes(frame[at // 8 : at // 8 + 2], "big") >> (12 - at % 8) & 15) + 1
        at += 9 + precision * (kind - 31)
    elif 8 <= kind <= 12:
        at += BITS * (kind - 8)
    else:
        return False
    return int.from_bytes(frame[at // 8 : at // 8 + 2], "big") >> (14 - at % 8) & 3 != 0


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Samples of 8-bit mono frames of any subframe kind; both checksums are verified.

    Whatever breaks the format raises Corrupt.
    """
    try:
        return _decode(frames)
    except (IndexError, OverflowError) as e:
        raise Corrupt("a frame is cut off") from e


def _decode(frames: list[bytes]) -> list[np.ndarray]:
    done: list[np.ndarray | None] = [None] * len(frames)
    heads = [frame_header(f, 0) for f in frames]
    order = sorted(range(len(frames)), key=lambda i: -heads[i][1])
    at = 0
    while at < len(order):
        n = heads[order[at]][1]
        some = order[at : at + max(1, (1 << 20) // n)]
        _decode_group(frames, heads, some, done)
        at += len(some)
    return done


def _decode_group(frames: list[bytes], heads: list[tuple[int, int, int]], some: list[int], done: list) -> None:
    by_size = sorted(some, key=lambda i: -len(frames[i]))
    length = np.array([len(frames[i]) for i in by_size])
    grid = np.zeros((len(some), int(length[0]) + 16), np.uint8)
    for j, i in enumerate(by_size):
        grid[j, : length[j]] = np.frombuffer(frames[i], np.uint8)
    rows = np.arange(len(some))
    stated = grid[rows, length - 2].astype(np.int64) << 8 | grid[rows, length - 1]
    if not np.array_equal(crc16(grid, length - 2), stated):
        raise Corrupt("a frame's CRC-16 differs")
    rice: list[tuple[int, int]] = []
    for j, i in enumerate(by_size):
        number, n, p = heads[i]
        f = frames[i]
        kind = f[p] >> 1 & 0x3F
        if f[p] & 0x80:
            raise Corrupt("a subframe header with reserved values")
        if unusual(f, p):
            done[i] = plain_frame(f)
        elif kind == 0:
            done[i] = np.full(n, f[p + 1], np.uint8).view(np.int8)
        elif kind == 1:
            if len(f) < p + 3 + n:
                raise Corrupt("a frame is cut off")
            done[i] = np.frombuffer(f, np.int8, n, p + 1)
        elif 8 <= kind <= 12 or kind >= 32:
            rice.append((j, i))
        else:
            raise Corrupt("a subframe of an unknown kind")
    if not rice:
        return
    rice.sort(key=lambda x: -heads[x[1]][1])
    row = np.array([j for j, _ in rice])
    ids = [i for _, i in rice]
    n = np.array([heads[i][1] for i in ids])
    kinds = np.array([frames[i][heads[i][2]] >> 1 & 0x3F for i in ids])
    order = np.where(kinds >= 32, kinds - 31, kinds - 8)
    stride = grid.shape[1]
    flat = np.concatenate([grid.ravel(), np.zeros(16, np.uint8)])
    base = row * stride
    pos = np.array([8 * (heads[i][2] + 1) for i in ids])  # bit position in the frame

    # 64-bit windows at every byte: a field of up to 25 bits or the next 57 bits of a unary run are one gather
    window = np.zeros(len(flat) - 7, np.uint64)
    for k in range(8):
        window |= flat[k : len(flat) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)

    def peek(at: np.ndarray, which: np.ndarray) -> np.ndarray:
        return window[base[which] + (at >> 3)] << (at & 7).astype(np.uint64)

    def take(which: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        w = np.asarray(width, np.uint64)
        got = (peek(pos[which], which) >> np.uint64(1)) >> (np.uint64(63) - w)
        pos[which] += np.asarray(width, np.int64)
        return got.astype(np.int64)

    def signed(v: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        half = np.int64(1) << (np.asarray(width, np.int64) - 1)
        return (v ^ half) - half

    longest, top = int(n[0]), int(order.max())
    out = np.zeros((longest, len(ids)), np.int64)
    every = np.arange(len(ids))
    for k in range(top):
        w = every[order > k]
        out[k, w] = signed(take(w, BITS), BITS)
    weights, scale = np.zeros((max(top, 4), len(ids)), np.int64), np.zeros(len(ids), np.int64)
    for k, c in FIXED.items():
        for lag, v in enumerate(c):
            weights[lag, (kinds == 8 + k)] = v
    lpc = every[kinds >= 32]
    if len(lpc):
        precision = take(lpc, 4) + 1
        scale[lpc] = signed(take(lpc, 5), 5)
        for k in range(top):
            on = order[lpc] > k
            weights[k, lpc[on]] = signed(take(lpc[on], precision[on]), precision[on])
    take(every, 2)
    level = take(every, 4)
    part = n >> level
    if (n % (1 << level)).any() or (part < order).any() or (scale < 0).any():
        raise Corrupt("residuals with reserved values")
    param, raw = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    left = np.zeros(len(ids), np.int64)  # residuals left in the partition
    started = np.zeros(len(ids), bool)
    lives = np.searchsorted(-n, -np.arange(longest), side="left").tolist()
    for i in range(int(order.min()), longest):
        live = lives[i]
        w = every[:live]
        if i < top:
            w = w[order[:live] <= i]
        new = w[left[w] == 0]
        if len(new):
            param[new] = take(new, 4)
            raw[new] = param[new] == RICE_ESCAPE
            if raw[new].any():
                esc = new[raw[new]]
                param[esc] = take(esc, 5)
            left[new] = np.where(started[new], part[new], part[new] - order[new])
            started[new] = True
            while (empty := new[left[new] == 0]).size:  # a first partition of warm-up samples only
                param[empty] = take(empty, 4)
                left[empty] = part[empty]
        left[w] -= 1
        whole = len(w) == live == len(ids)
        p = param if whole else param[w]
        at = pos if whole else pos[w]
        b = base if whole else base[w]
        bits = window[b + (at >> 3)] << (at & 7).astype(np.uint64)
        # the leading zeros: of a float's exponent, exact here as the low bits are cleared first
        high = bits & np.uint64(0xFFFFFFFFFFFFF800)
        zeros = 64 - np.frexp(high.astype(np.float64))[1].astype(np.int64)
        q = np.where(high > 0, zeros, 0)
        at = at + q + 1
        far = high == 0
        if far.any():  # a unary run longer than one window
            at[far] -= 1
            for f in np.flatnonzero(far).tolist():
                j = int(w[f])
                run, a = 0, int(at[f])
                while not flat[base[j] + (a >> 3)] >> (7 - (a & 7)) & 1:
                    run, a = run + 1, a + 1
                q[f], at[f] = run, a + 1
        bits = window[b + (at >> 3)] << (at & 7).astype(np.uint64)
        low = ((bits >> np.uint64(1)) >> (63 - p).astype(np.uint64)).astype(np.int64)
        v = q << p | low
        v = (v >> 1) ^ -(v & 1)
        at = at + p
        if raw[w].any():
            esc = raw[w]
            first = pos[w][esc]
            got = (window[base[w[esc]] + (first >> 3)] << (first & 7).astype(np.uint64)) >> np.uint64(1) >> (63 - p[esc]).astype(np.uint64)
            v[esc] = np.where(p[esc] > 0, signed(got.astype(np.int64), np.maximum(p[esc], 1)), 0)
            at[esc] = first + p[esc]
        pos[w] = at
        guess = np.zeros(len(w), np.int64)
        for lag in range(min(top, i)):
            guess += weights[lag, w] * out[i - 1 - lag, w]
        out[i, w] = v + (guess >> scale[w])
    out = np.ascontiguousarray(out.T.astype(np.int8))
    for j, i in enumerate(ids):
        done[i] = out[j, : n[j]]


def split_frames(data: bytes) -> list[bytes]:
    """A stream's frames."""
    return [data[a:b] for _, _, a, b in frame_table(data)[1]]


def decode(streams: list[bytes]) -> list[bytes]:
    """The byte strings that encode() was given; every frame's CRCs and each stream's MD5 (where stated) are verified."""
    tables = [frame_table(s) for s in streams]
    samples, at, out = decode_frames([s[a:b] for s, (_, t) in zip(streams, tables, strict=True) for _, _, a, b in t]), 0, []
    for info, t in tables:
        whole = np.concatenate([np.zeros(0, np.int8), *samples[at : at + len(t)]])
        at += len(t)
        if info["samples"] not in (0, len(whole)) or any(info["md5"]) and hashlib.md5(whole.tobytes()).digest() != info["md5"]:
            raise Corrupt("the decoded samples differ from STREAMINFO")
        out.append((whole.view(np.uint8) ^ 0x80).tobytes())
    return out


def read_samples(data: bytes, first: int, count: int) -> np.ndarray:
    """Samples ``first`` to ``first + count`` of a stream; only the frames that hold them are decoded."""
    hit = [x for x in frame_table(data)[1] if x[0] < first + count and x[0] + x[1] > first]
    if not hit:
        return np.zeros(0, np.int8)
    start = first - hit[0][0]
    return np.concatenate(decode_frames([data[a:b] for _, _, a, b in hit]))[max(start, 0) : start + count]


def pcm_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """FLAC streams as PCM blocks that can be sought by sample: one row for each frame; no shuffle.

    Returns ``doc_id, block, first_sample, n_samples, byte_offset, pcm`` (signed 8-bit samples; ``byte_offset`` is the
    frame's place in the stream). A null stream, or one without frames, gives no rows; a broken one raises Corrupt;
    null ids and repeated rows are kept; other columns are ignored.
    """
    names = ["doc_id", "block", "first_sample", "n_samples", "byte_offset", "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", 1 << 20):
            for doc, data in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True):
                table = frame_table(data)[1] if data is not None else []
                for at in range(0, len(table), 256):  # a megabyte of samples at a time
                    some = table[at : at + 256]
                    pcm = [x.tobytes() for x in decode_frames([data[a:b] for _, _, a, b in some])]
                    columns = [[doc] * len(some), [at + i for i in range(len(some))], [x for x, *_ in some], [n for _, n, *_ in some], [a for _, _, a, _ in some], pcm]
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    media = df.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.col(quoted(media_col)).alias("media"))
    return media.mapInArrow(run, "doc_id bigint, block int, first_sample bigint, n_samples int, byte_offset bigint, pcm binary")


def padded(text: str, multiple: int = 64) -> bytes:
    """A text in UTF-8 with zero bytes up to a positive multiple of ``multiple``."""
    raw = text.encode("utf-8", "replace")
    return raw + bytes(-len(raw) % multiple or (0 if raw else multiple))


def describe(payload: bytes, media: bytes) -> str:
    """Frames, peak, root mean square, zero crossings and the largest step of the samples, as text."""
    x = (np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8).astype(np.int64)
    frames = len(metadata(media)[1])
    rms = float(np.sqrt((x * x).mean()))
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"frames={frames};peak={int(np.abs(x).max())};rms={rms:.4f};crossings={crossings};step={int(np.abs(np.diff(x)).max())}"


def flac_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, block: int = BLOCK) -> DataFrame:
    """Store each text as a FLAC stream, read the stream back and describe its samples; no shuffle.

    Returns ``doc_id, n_bytes, payload, media, feature``; with ``digests``: ``doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature``, taken from what was read back. A null
    text counts as empty (64 zero bytes); null ids and repeated rows are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=2 << 20):
            raw = [padded(t) for t in texts(part)]
            n = pa.array([len(t.encode("utf-8", "replace")) for t in texts(part)], pa.int64())
            media = encode(raw, block)
            back = decode(media)
            feature = pa.array([describe(p, m) for p, m in zip(back, media, strict=True)], pa.string())
            if not digests:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n, pa.array(back, pa.binary()), pa.array(media, pa.binary()), feature], names=["doc_id", "n_bytes", "payload", "media", "feature"])
                continue
            columns = [
                part.column("doc_id"), n, pa.array([len(p) for p in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back]),
                pa.array([zlib.crc32(p[-64:]) for p in back], pa.int64()), pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media]), feature,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" if digests else "doc_id bigint, n_bytes bigint, payload binary, media binary, feature string"
    return id_text(df, id_col, text_col).mapInArrow(run, schema)
