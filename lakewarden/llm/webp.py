"""Operator 10: media columns of lossless WebP images.

``decode`` reads a lossless WebP file: prefix codes (simple and normal, one group or
many by an entropy image), back-references with the two-dimensional distance map, the
colour cache, and the inverse predictor, cross-colour, subtract-green and palette
transforms. ``encode`` writes files with any of these, chosen by arguments.

Images are arrays of 32-bit ARGB pixels. A payload of bytes is stored as opaque RGB,
three bytes a pixel, 192 pixels a row, in as many images as the format's largest height
asks for.

Decoding one group without a colour cache (what ``encode`` makes of payloads) looks the
codes of a window of the data up at once: for every bit position numpy finds the position
after a whole pixel, and after four, that would start there; a short walk then follows the
true starts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.shared import written

ROW = 576
WIDTH = ROW // 3
MAX_ROWS = 1 << 14

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIGNATURE = 0x2F
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
MAX_CODE = 15
MAX_COPY = 4096
#: Shorter repeats are written as literals: with no copies at all three colours share a code.
LEAST_COPY = 128
#: Bytes whose bit positions are looked up at once when reading.
WINDOW = 1 << 13

#: Bits that a transform must save before a payload is stored with it.
LEAST_GAIN = 400

#: The 120 near neighbours by distance, then by |x|, positive x first.
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0])
)


def _ceil_shift(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


# ---------------------------------------------------------------- prefix codes


_REVERSED = np.zeros(1 << MAX_CODE, np.int32)
for _bit in range(MAX_CODE):
    _REVERSED |= (np.arange(1 << MAX_CODE, dtype=np.int32) >> _bit & 1) << (MAX_CODE - 1 - _bit)


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used symbols in code order, and where each one's code starts among all 15-bit words."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    share = 1 << (MAX_CODE - lengths[order])
    return order, np.cumsum(share) - share


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Bit-reversed canonical codes for code lengths (0: unused)."""
    lengths = np.asarray(lengths)
    order, start = _in_order(lengths)
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = _REVERSED[start]
    return codes


class Code:
    """A decoding table over the next ``bits`` bits, the longest code's: symbol and length."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths)
        order, _ = _in_order(lengths)
        self.single = len(order) == 1
        if self.single:
            self.bits, self.mask = 0, 0
            self.symbol, self.length = order.astype(np.int32), np.zeros(1, np.int32)
            return
        if not len(order) or int((1 << (MAX_CODE - lengths[order])).sum()) != 1 << MAX_CODE:
            raise ValueError("incomplete prefix code")
        self.bits = int(lengths.max())
        self.mask = (1 << self.bits) - 1
        straight = np.repeat(order.astype(np.int32), 1 << (self.bits - lengths[order]))
        self.symbol = straight[_REVERSED[: 1 << self.bits] >> (MAX_CODE - self.bits)]
        self.length = lengths.astype(np.int32)[self.symbol]

    @cached_property
    def pairs(self) -> list[tuple[int, int]]:
        """Symbol and length as plain numbers, for reading one by one."""
        return list(zip(self.symbol.tolist(), self.length.tolist(), strict=True))

    def wide(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length over the next ``bits`` bits."""
        times = 1 << (bits - self.bits)
        if times == 1:
            return self.symbol, self.length
        return np.tile(self.symbol, times), np.tile(self.length, times)


@lru_cache(maxsize=64)
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.int64))


@lru_cache(maxsize=4096)
def _pairs(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """``Code.pairs`` of a short code, without arrays."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return [(used[0][1], 0)]
    bits = used[-1][0] if used else 0
    table: list = [None] * (1 << bits)
    start = 0
    for n, s in used:
        if start >= 1 << MAX_CODE:
            raise ValueError("incomplete prefix code")
        table[int(_REVERSED[start]) :: 1 << n] = [(s, n)] * (1 << (bits - n))
        start += 1 << (MAX_CODE - n)
    if start != 1 << MAX_CODE:
        raise ValueError("incomplete prefix code")
    return table


def huffman_lengths(counts: np.ndarray, most: int = MAX_CODE) -> np.ndarray:
    """Code lengths of at most ``most`` bits; one used symbol has length 1."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used]
    while True:
        # Nodes come in the order of their weights, so the lightest is the next leaf or the next inner node.
        order = np.argsort(weights, kind="stable")
        rest = weights[order].tolist()
        rest.append(1 << 62)
        inner, parent = [], [0] * (2 * n - 1)
        leaf = node = 0
        for fresh in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if node == len(inner) or rest[leaf] <= inner[node]:
                    total += rest[leaf]
                    parent[leaf] = fresh
                    leaf += 1
                else:
                    total += inner[node]
                    parent[n + node] = fresh
                    node += 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if depth[0] <= most:
            lengths[used[order]] = depth[:n]
            return lengths
        weights = weights // 2 + 1  # flatter counts make a shallower tree


def prefix_value(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their value for a length or distance of at least 1."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    second = value >> (high - 1) & 1
    return 2 * high + second, high - 1, value & ((1 << (high - 1)) - 1)


# ---------------------------------------------------------------- reading


class BitReader:
    def __init__(self, data: bytes):
        self.data = data
        self.at = 0
        self.end = 8 * len(data)

    def bits(self, n: int) -> int:
        at = self.at
        first = at >> 3
        value = int.from_bytes(self.data[first : first + (n >> 3) + 2], "little") >> (at & 7)
        self.at = at + n
        if self.at > self.end:
            raise ValueError("truncated image")
        return value & ((1 << n) - 1)

    def peek(self, at: int, n: int) -> int:
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        first = self.at >> 3
        ahead = int.from_bytes(self.data[first : first + 3], "little") >> (self.at & 7) & code.mask
        found, size = code.pairs[ahead]
        self.at += size
        if self.at > self.end:
            raise ValueError("truncated image")
        return found

    def extended(self, prefix: int) -> int:
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.bits(extra) + 1


def _read_code(r: BitReader, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if r.bits(1):
        two = r.bits(1)
        lengths[r.bits(8 if r.bits(1) else 1)] = 1
        if two:
            lengths[r.bits(8)] = 1
        return _code(lengths.tobytes())
    shown = 4 + r.bits(4)
    sizes, own = r.bits(3 * shown), [0] * 19
    for i in range(shown):
        own[CODE_LENGTH_ORDER[i]] = sizes >> 3 * i & 7
    pairs = _pairs(tuple(own))
    mask = len(pairs) - 1
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    found, last = [], 8
    at, ahead, known = r.at, 0, 0  # some bits ahead as one number
    while len(found) < alphabet and left:
        left -= 1
        if known < 14:
            ahead, known = int.from_bytes(r.data[at >> 3 : (at >> 3) + 32], "little") >> (at & 7), 249
        s, size = pairs[ahead & mask]
        if s < 16:
            found.append(s)
            last = s or last
        else:
            base, extra = ((3, 2), (3, 3), (11, 7))[s - 16]
            repeat = base + (ahead >> size & ((1 << extra) - 1))
            size += extra
            found += [last if s == 16 else 0] * repeat
        at += size
        ahead >>= size
        known -= size
    if len(found) > alphabet:
        raise ValueError("code lengths overflow")
    r.at = at
    if at > r.end:
        raise ValueError("truncated image")
    lengths[: len(found)] = found
    last_used = int(np.flatnonzero(lengths)[-1]) + 1 if lengths.any() else 0
    return _code(lengths[: max(256, last_used)].tobytes())


def _read_group(r: BitReader, cache_size: int) -> list[Code]:
    """The five codes of a group. A blue code written as the red one was is not parsed again."""
    green = _read_code(r, 280 + cache_size)
    start = r.at
    red = _read_code(r, 256)
    size = r.at - start
    if r.at + size <= r.end and r.peek(start, size) == r.peek(r.at, size):
        r.at += size
        blue = red
    else:
        blue = _read_code(r, 256)
    return [green, red, blue, _read_code(r, 256), _read_code(r, 40)]


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, distance: int, length: int) -> None:
    if distance > at or at + length > len(out):
        raise ValueError("back-reference outside the image")
    if distance >= length:
        out[at : at + length] = out[at - distance : at - distance + length]
    else:
        out[at : at + length] = np.resize(out[at - distance : at], length)


class _Window:
    """A stretch of the data from bit ``at`` on, whose codes are looked up at all bit positions at once."""

    def __init__(self, data: bytes, at: int, codes: list[Code], bits: int):
        start = at >> 3
        piece = data[start : start + WINDOW]
        raw = np.frombuffer(piece + b"\0\0\0\0", np.uint8).astype(np.int64)
        base = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
        self.ahead = (base[:, None] >> np.arange(8)).ravel()
        self.ahead &= (1 << bits) - 1
        self.codes, self.bits, self.start, self.n = codes, bits, 8 * start, len(self.ahead)
        # A pixel that may reach over the end is left to the next window.
        self.stop = self.n + 1 if start + WINDOW >= len(data) else 8 * len(piece) - 4 * MAX_CODE
        # Where the symbol after one starts, by code, for every bit; all lead to n, the end, and stay there.
        places, self.hops = np.arange(self.n + 1), {}
        for code in codes:
            if not code.single and code not in self.hops:
                hop = places.copy()
                hop[:-1] += code.wide(bits)[1][self.ahead]
                self.hops[code] = np.minimum(hop, self.n, out=hop)
        green = codes[0]
        after = self.hops.get(green, places)
        if int(green.symbol.max()) >= 256:
            # A literal's step; a symbol that is none leads nowhere.
            after = after.copy()
            after[:-1][(green.wide(bits)[0] >= 256)[self.ahead]] = self.n
        for code in codes[1:]:
            if not code.single:
                after = self.hops[code][after]
        self.after, self.twice = after, after[after]

    def pixels(self, fours: list[int], singles: list[int]) -> np.ndarray:
        """The pixels that start at ``singles``, and four each at ``fours``, in order."""
        at = np.array(fours, np.int64)
        then = self.twice[at]
        at = np.stack((at, self.after[at], then, self.after[then]), axis=1).ravel()
        if singles:
            at = np.sort(np.concatenate((at, np.array(singles, np.int64))))
        out = np.zeros(len(at), np.uint32)
        for code, shift in zip(self.codes, (8, 16, 0, 24), strict=True):
            if code.single:
                out |= np.uint32(int(code.symbol[0]) << shift & 0xFFFFFFFF)
            else:
                out |= code.wide(self.bits)[0][self.ahead[at]].astype(np.uint32) << np.uint32(shift)
                at = self.hops[code][at]
        return out


def _read_simple(r: BitReader, codes: list[Code], width: int, count: int) -> np.ndarray:
    """One prefix group, no colour cache: windows of single pixels, copies one by one."""
    green, red, blue, alpha, far = codes
    codes = codes[:4]
    if all(c.single for c in codes) and green.symbol[0] < 256:
        pixel = int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(green.symbol[0]) << 8 | int(blue.symbol[0])
        return np.full(count, pixel, np.uint32)
    bits = max(1, *(c.bits for c in codes))
    parts: list[np.ndarray] = []
    copies: list[tuple[int, int, int]] = []  # pixels before it, length, distance
    made, most = 0, count - 4
    while made < count:
        window = _Window(r.data, r.at, codes, bits)
        start, stop, n = window.start, window.stop, window.n
        at = r.at - start
        one, four = memoryview(window.after), memoryview(window.twice[window.twice])
        singles: list[int] = []
        fours: list[int] = []
        while made < count and at < stop:
            then = four[at]
            if then < n and then < stop and made <= most:
                fours.append(at)
                made += 4
                at = then
                continue
            then = one[at]
            if then < n:
                singles.append(at)
                made += 1
                at = then
                continue
            r.at = at + start
            s = r.symbol(green)
            if s < 256:
                raise ValueError("truncated image")
            length = r.extended(s - 256)
            distance = _distance(r.extended(r.symbol(far)), width)
            copies.append((made, length, distance))
            made += length
            at = r.at - start
        r.at = at + start
        if r.at > r.end or made > count:
            raise ValueError("truncated image")
        parts.append(window.pixels(fours, singles))
    literal = np.concatenate(parts) if len(parts) > 1 else parts[0]
    if not copies:
        return literal
    out, used, place = np.empty(count, np.uint32), 0, 0
    for before, length, distance in copies:
        out[place:before] = literal[used : used + before - place]
        used += before - place
        _copy(out, before, distance, length)
        place = before + length
    out[place:] = literal[used:]
    return out


def _read_pixels(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, meta, meta_bits = 1, None, 0
    if main and r.bits(1):
        meta_bits = r.bits(3) + 2
        entropy = _read_pixels(r, _ceil_shift(width, meta_bits), _ceil_shift(height, meta_bits), False)
        meta = (entropy >> 8 & 0xFFFF).reshape(_ceil_shift(height, meta_bits), -1)
        groups = int(meta.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [_read_group(r, cache_size) for _ in range(groups)]
    count = width * height
    if groups == 1 and not cache_size:
        return _read_simple(r, codes[0], width, count)
    out = np.zeros(count, np.uint32)
    cache = [0] * max(1, cache_size)
    at = stored = 0

    def remember(upto: int) -> None:
        for pixel in out[stored:upto].tolist():
            cache[(CACHE_MULTIPLIER * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel

    while at < count:
        own = codes[0] if meta is None else codes[int(meta[at // width >> meta_bits, at % width >> meta_bits])]
        s = r.symbol(own[0])
        if s < 256:
            red, blue, alpha = r.symbol(own[1]), r.symbol(own[2]), r.symbol(own[3])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = r.extended(s - 256)
            _copy(out, at, _distance(r.extended(r.symbol(own[4])), width), length)
            at += length
        else:
            remember(at)
            stored = at
            out[at] = cache[s - 280]
            at += 1
    return out


# ---------------------------------------------------------------- transforms


def _split(pixels: np.ndarray) -> np.ndarray:
    """Rows of A, R, G, B as int32, shape (..., 4)."""
    return np.stack([pixels >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _join(parts: np.ndarray) -> np.ndarray:
    p = (parts & 0xFF).astype(np.uint32)
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def _predict(mode: int, left, top, corner, right) -> list[int]:
    """Predicted A, R, G, B of one pixel from its left, top, top-left and top-right ones."""

    def half(a, b):
        return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]

    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        middle = half(left, top)
        # The halved difference rounds towards zero.
        return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(middle, corner, strict=True)]
    return [255, 0, 0, 0]


def _run_even(parts: np.ndarray, mode: int, forward: bool) -> np.ndarray:
    """The left (1) or top (2) predictor for a whole image (height, width, channels): differences, or their sums."""
    out = parts.copy()
    first = out[:1, :] if mode == 2 else out[:, :1]  # the edge that the other neighbour predicts
    along, across = (0, 1) if mode == 2 else (1, 0)
    if forward:
        # An opaque black pixel comes before the first one.
        edge = parts[:1, :] if mode == 2 else parts[:, :1]
        body, ahead = (out[1:], parts[:-1]) if mode == 2 else (out[:, 1:], parts[:, :-1])
        body -= ahead
        first[...] = np.diff(edge, axis=across, prepend=np.zeros_like(edge.take([0], axis=across)))
        if parts.shape[2] == 4:
            out[0, 0, 0] -= 255
        return out
    if parts.shape[2] == 4:
        out[0, 0, 0] += 255
    first[...] = np.cumsum(first, axis=across, dtype=out.dtype)
    return np.cumsum(out, axis=along, dtype=out.dtype)


def _run_predictor(pixels: np.ndarray, modes: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Add (or, forward, subtract) predictions; ``modes`` per block in the green byte."""
    height, width = pixels.shape
    plain = {int(m) >> 8 & 15 for m in np.unique(modes)} if modes.size else set()
    if len(plain) == 1 and plain <= {1, 2}:
        return _join(_run_even(_split(pixels), plain.pop(), forward))
    given = _split(pixels).tolist()
    result = [[None] * width for _ in range(height)]
    known = given if forward else result
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = known[0][x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                guess = known[y - 1][0]
            else:
                above = known[y - 1]
                # The last pixel's top-right neighbour is the first one of its own row.
                right = above[x + 1] if x + 1 < width else known[y][0]
                mode = int(modes[y >> bits, x >> bits]) >> 8 & 15
                guess = _predict(mode, known[y][x - 1], above[x], above[x - 1], right)
            sign = -1 if forward else 1
            result[y][x] = [(v + sign * g) & 255 for v, g in zip(given[y][x], guess, strict=True)]
    return _join(np.array(result, np.int32).reshape(height, width, 4))


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 0xFF) ^ 0x80) - 0x80


def _run_cross(pixels: np.ndarray, elements: np.ndarray, bits: int, forward: bool) -> np.ndarray:
    """Cross-colour: element bytes R, G, B are red-to-blue, green-to-blue, green-to-red."""
    height, width = pixels.shape
    p = _split(pixels)
    e = _signed(_split(elements))[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    sign = -1 if forward else 1
    green = _signed(p[..., 2])
    red = p[..., 1] + sign * (e[..., 3] * green >> 5)
    plain_red = _signed(p[..., 1] if forward else red)
    blue = p[..., 3] + sign * ((e[..., 2] * green >> 5) + (e[..., 1] * plain_red >> 5))
    return _join(np.stack((p[..., 0], red, p[..., 2], blue), axis=-1))


def _run_green(pixels: np.ndarray, forward: bool) -> np.ndarray:
    p = _split(pixels)
    sign = -1 if forward else 1
    p[..., 1] += sign * p[..., 2]
    p[..., 3] += sign * p[..., 2]
    return _join(p)


def _bundle_bits(colors: int) -> int:
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def _unbundle(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = _bundle_bits(len(table))
    index = pixels >> 8 & 0xFF
    if bits:
        each = 8 >> bits
        shifts = np.arange(1 << bits, dtype=np.uint32) * np.uint32(each)
        index = (index[..., None] >> shifts & ((1 << each) - 1)).reshape(len(pixels), -1)[:, :width]
    full = np.concatenate((table, np.zeros(256, np.uint32)))
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (height, width) of a lossless WebP file; ValueError where it is damaged."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25 or data[20] != SIGNATURE:
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    if 20 + size > len(data):
        raise ValueError("truncated image")
    r = BitReader(data[21 : 20 + size])
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    undo, seen, inner = [], set(), width
    while r.bits(1):
        kind = r.bits(2)
        if kind in seen:
            raise ValueError("repeated transform")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            bits = r.bits(3) + 2
            shape = (_ceil_shift(height, bits), _ceil_shift(inner, bits))
            undo.append((kind, _read_pixels(r, shape[1], shape[0], False).reshape(shape), bits, inner))
        elif kind == PALETTE:
            colors = r.bits(8) + 1
            deltas = _split(_read_pixels(r, colors, 1, False))
            undo.append((kind, _join(np.cumsum(deltas, axis=0)), 0, inner))
            inner = _ceil_shift(inner, _bundle_bits(colors))
        else:
            undo.append((kind, None, 0, inner))
    pixels = _read_pixels(r, inner, height, True).reshape(height, inner)
    for kind, image, bits, before in reversed(undo):
        if kind == PREDICTOR:
            pixels = _run_predictor(pixels, image, bits, False)
        elif kind == CROSS_COLOR:
            pixels = _run_cross(pixels, image, bits, False)
        elif kind == SUBTRACT_GREEN:
            pixels = _run_green(pixels, False)
        else:
            pixels = _unbundle(pixels, image, before)
    return pixels


# ---------------------------------------------------------------- writing


class BitWriter:
    def __init__(self):
        self.value = 0
        self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


@lru_cache(maxsize=4096)
def _code_header(table: bytes) -> tuple[int, int]:
    """Bits and their number that describe a prefix code, by its 64-bit lengths."""
    lengths = np.frombuffer(table, np.int64)
    w = BitWriter()
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return w.value, w.size
    w.put(0, 1)
    runs = []  # (symbol, extra value, extra bits)
    edges = [0, *(np.flatnonzero(lengths[1:] != lengths[:-1]) + 1).tolist(), len(lengths)]
    for at, n in enumerate(lengths[edges[:-1]].tolist()):
        length = edges[at + 1] - edges[at]
        if n:
            runs.append((n, 0, 0))
            length -= 1
        while length:
            if n == 0 and length >= 11:
                k = min(length, 138)
                runs.append((18, k - 11, 7))
            elif n == 0 and length >= 3:
                k = min(length, 10)
                runs.append((17, k - 3, 3))
            elif n and length >= 3:
                k = min(length, 6)
                runs.append((16, k - 3, 2))
            else:
                k = 1
                runs.append((n, 0, 0))
            length -= k
    own = huffman_lengths(np.bincount([s for s, _, _ in runs], minlength=19), 7)
    codes, widths = (a.tolist() for a in _written_code(own))
    sizes = own.tolist()
    shown = max(4, 1 + max(i for i, s in enumerate(CODE_LENGTH_ORDER) if sizes[s]))
    w.put(shown - 4, 4)
    for s in CODE_LENGTH_ORDER[:shown]:
        w.put(sizes[s], 3)
    w.put(0, 1)
    value, size = w.value, w.size
    for s, extra, bits in runs:
        value |= (codes[s] | extra << widths[s]) << size
        size += widths[s] + bits
    return value, size


def _written_code(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their sizes for writing; one used symbol is written with no bits."""
    if np.count_nonzero(lengths) < 2:
        nothing = np.zeros(len(lengths), np.int64)
        return nothing, nothing
    return canonical(lengths), lengths


def _fields(values: np.ndarray, sizes: np.ndarray) -> tuple[int, int]:
    """Concatenated little-endian bit fields of at most 63 bits: one number, and its bits."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    starts = ends - sizes
    shift, word = (starts & 63).astype(np.uint64), starts >> 6
    values = values.astype(np.uint64)
    words = np.zeros((total >> 6) + 2, np.uint64)
    np.add.at(words, word, values << shift)
    # What is left for the next word; shifts by 64 at once are not defined.
    np.add.at(words, word + 1, values >> np.uint64(1) >> (np.uint64(63) - shift))
    return int.from_bytes(words.astype("<u8", copy=False).tobytes(), "little"), total


def _runs(pixels: np.ndarray, distance: int, least: int) -> list[tuple[int, int]]:
    """Stretches ``(start, length)`` that repeat the pixels ``distance`` before."""
    if len(pixels) <= distance:
        return []
    same = np.concatenate(([False], pixels[distance:] == pixels[:-distance], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(a + distance, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least]


def _pixel_bits(
    pixels: np.ndarray, width: int, distances=(1,), cache_bits: int = 0, meta_bits: int = 0, main: bool = True
) -> tuple[int, int]:
    """One entropy-coded image, as a number and its bits: literals, copies at the given distances, cache hits, code groups."""
    flat = pixels.ravel().astype(np.int64)
    n = len(flat)
    copies: list[tuple[int, int, int]] = []
    for distance in distances:
        for start, length in _runs(flat, distance, LEAST_COPY):
            while length >= LEAST_COPY:
                copies.append((start, min(length, MAX_COPY), distance))
                start, length = start + MAX_COPY, length - MAX_COPY
    copies.sort()
    literal, place, kept = np.ones(n, bool), 0, []
    for start, length, distance in copies:
        if start >= place:
            kept.append((start, length, distance))
            literal[start : start + length] = False
            place = start + length
    if cache_bits:
        cached, held = np.full(n, -1, np.int64), {}
        for i, p in enumerate(flat.tolist()):
            key = (CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)
            if literal[i] and held.get(key, 0) == p:
                cached[i] = key
            held[key] = p
    at = np.flatnonzero(literal) if kept else np.arange(n)
    if meta_bits:
        rows = np.arange(n) // width >> meta_bits
        cols = np.arange(n) % width >> meta_bits
        across = _ceil_shift(width, meta_bits)
        group_of = (rows * across + cols) % 2
        meta = np.zeros((int(rows[-1]) + 1) * across, np.uint32)
        meta[rows * across + cols] = group_of << 8
        groups = int(group_of.max()) + 1
    else:
        groups = 1

    head = BitWriter()
    head.put(1 if cache_bits else 0, 1)
    if cache_bits:
        head.put(cache_bits, 4)
    if main:
        head.put(1 if meta_bits else 0, 1)
        if meta_bits:
            head.put(meta_bits - 2, 3)
            head.put(*_pixel_bits(meta, across, main=False))
    alphabet = 280 + ((1 << cache_bits) if cache_bits else 0)
    values, sizes, order = [], [], []
    for g in range(groups):
        where = at[group_of[at] == g] if groups > 1 else at
        own = flat[where] if len(where) < n else flat
        green, red, blue, alpha = (own >> shift & 255 for shift in (8, 16, 0, 24))
        shown = slice(None)  # literals among what is written
        if cache_bits:
            key = cached[where]
            shown = key < 0
            green = np.where(shown, green, 280 + key)
        first = np.bincount(green, minlength=alphabet)
        # Red and blue share one code: a table less to build, to write and to read.
        both = np.bincount(red[shown], minlength=256) + np.bincount(blue[shown], minlength=256)
        far = np.zeros(40, np.int64)
        mine = [c for c in kept if group_of[c[0]] == g] if groups > 1 else kept
        for _, length, distance in mine:
            first[256 + prefix_value(length)[0]] += 1
            far[prefix_value(distance + 120)[0]] += 1
        if kept or cache_bits:
            pair, first = huffman_lengths(both), huffman_lengths(first)
            pair_code, first_code = _written_code(pair), _written_code(first)
        else:
            # Green holds literals only here, so it shares that code too.
            pair = huffman_lengths(both + first[:256])
            first = np.concatenate((pair, np.zeros(alphabet - 256, np.int64)))
            pair_code = first_code = _written_code(pair)
        opaque, far = huffman_lengths(np.bincount(alpha[shown], minlength=256)), huffman_lengths(far)
        for table in (first, pair, pair, opaque, far):
            head.put(*_code_header(table.tobytes()))
        # A pixel's codes follow each other: one field.
        value, size = first_code[0][green], first_code[1][green]
        for symbols, (codes, widths) in ((red, pair_code), (blue, pair_code), (alpha, _written_code(opaque))):
            if widths.any():
                more, wider = codes[symbols], widths[symbols]
                if cache_bits:
                    more, wider = more * shown, wider * shown
                value |= more << size
                size += wider
        values.append(value)
        sizes.append(size)
        order.append(where)
        if mine:
            far_code = _written_code(far)
            for start, length, distance in mine:
                field, wide = 0, 0
                for (codes, widths), amount, base in ((first_code, length, 256), (far_code, distance + 120, 0)):
                    s, extra, rest = prefix_value(amount)
                    field |= int(codes[base + s]) << wide
                    wide += int(widths[base + s])
                    field |= rest << wide
                    wide += extra
                values.append(np.array([field]))
                sizes.append(np.array([wide]))
                order.append(np.array([start]))
    value, size = np.concatenate(values), np.concatenate(sizes)
    if groups > 1 or kept:
        by = np.argsort(np.concatenate(order), kind="stable")
        value, size = value[by], size[by]
    head.put(*_fields(value, size))
    return head.value, head.size


def encode(
    pixels: np.ndarray,
    palette: bool | None = None,
    subtract_green: bool = False,
    predictor: np.ndarray | None = None,
    cross: np.ndarray | None = None,
    block_bits: int = 3,
    cache_bits: int = 0,
    meta_bits: int = 0,
    distances: tuple[int, ...] | None = None,
) -> bytes:
    """A lossless WebP file of ARGB ``pixels`` (height, width), each side 1 to 16384.

    ``predictor`` holds a mode 0 to 13 and ``cross`` an ARGB element for each block of
    ``2**block_bits``. A palette is used where at most 16 colours occur, unless told.
    """
    height, width = pixels.shape
    pixels = pixels.astype(np.uint32)
    w = BitWriter()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int((pixels >> 24 != 255).any()), 1)
    w.put(0, 3)
    colors = None
    if palette is not False:
        few = 256 if palette else 16
        colors = np.array(sorted(set(pixels.ravel()[:128].tolist())), np.uint32)
        if len(colors) <= few:
            colors = np.unique(pixels)
        if len(colors) > few:
            colors = None

    def transform(kind: int) -> None:
        w.put(1, 1)
        w.put(kind, 2)

    def flush(image: np.ndarray, across: int) -> None:
        w.put(*_pixel_bits(image, across, main=False))

    if colors is not None:
        transform(PALETTE)
        w.put(len(colors) - 1, 8)
        split = _split(colors)
        flush(_join(np.diff(split, axis=0, prepend=np.zeros((1, 4), np.int32))), len(colors))
        index = np.searchsorted(colors, pixels).astype(np.uint32)
        bits = _bundle_bits(len(colors))
        if bits:
            inner = _ceil_shift(width, bits)
            padded = np.zeros((height, inner << bits), np.uint32)
            padded[:, :width] = index
            shifts = np.arange(1 << bits, dtype=np.uint32) * np.uint32(8 >> bits)
            index = (padded.reshape(height, inner, 1 << bits) << shifts).sum(axis=2, dtype=np.uint32)
            width = inner
        pixels = np.uint32(0xFF000000) | index << 8
    if predictor is not None:
        transform(PREDICTOR)
        w.put(block_bits - 2, 3)
        modes = np.uint32(0xFF000000) | predictor.astype(np.uint32) << 8
        flush(modes, modes.shape[1])
        pixels = _run_predictor(pixels, modes, block_bits, True)
    if cross is not None:
        transform(CROSS_COLOR)
        w.put(block_bits - 2, 3)
        flush(cross.astype(np.uint32), cross.shape[1])
        pixels = _run_cross(pixels, cross.astype(np.uint32), block_bits, True)
    if subtract_green:
        transform(SUBTRACT_GREEN)
        pixels = _run_green(pixels, True)
    w.put(0, 1)
    w.put(*_pixel_bits(pixels, width, distances or (1, width), cache_bits, meta_bits))
    data = bytes([SIGNATURE]) + w.value.to_bytes((w.size + 7) // 8, "little")
    pad = len(data) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(data) + pad) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * pad


# ---------------------------------------------------------------- payloads


def pad_payload(text: str | None) -> tuple[int, bytes]:
    data = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (-len(data) % ROW if data else ROW)


def _entropies(images: list[np.ndarray]) -> list[float]:
    """Bits of each image's samples under one code for all, as ``encode`` gives to literals."""
    counts = np.stack([np.bincount(image.ravel(), minlength=256) for image in images])
    size = images[0].size
    return (size * np.log2(size) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=1)).tolist()


def chosen(rgb: np.ndarray) -> dict:
    """Options of ``encode`` for samples (height, width, 3) of one byte: the predictor (none, left, top) and green that leave fewest bits.

    A transform costs its own description, so it must save more than ``LEAST_GAIN`` bits.
    """
    tried, images = [], []
    for mode in (0, 1, 2):
        left = _run_even(rgb, mode, True) if mode else rgb
        less = left.copy()
        less[..., 0] -= less[..., 1]
        less[..., 2] -= less[..., 1]
        tried += [(mode, False), (mode, True)]
        images += [left, less]
    bits = _entropies(images)
    least = min(range(6), key=bits.__getitem__)
    if bits[least] >= bits[0] - LEAST_GAIN:
        return {}
    mode, green = tried[least]
    own = {"subtract_green": green, "palette": False, "block_bits": 9}
    if mode:
        height, width = rgb.shape[:2]
        own["predictor"] = np.full((_ceil_shift(height, 9), _ceil_shift(width, 9)), mode)
    return own


def store_payload(payload: bytes) -> bytes:
    """Bytes (a multiple of 576) as one or more WebP files, one after the other, each with the transforms that suit it."""
    files = []
    for start in range(0, len(payload), ROW * MAX_ROWS):
        samples = np.frombuffer(payload[start : start + ROW * MAX_ROWS], np.uint8).reshape(-1, WIDTH, 3)
        rgb = samples.astype(np.uint32)
        pixels = np.uint32(0xFF000000) | rgb[..., 0] << 16 | rgb[..., 1] << 8 | rgb[..., 2]
        # Copies and palettes are no part of the estimate: where it asks for transforms, the smaller file stays.
        file, own = encode(pixels), chosen(samples)
        files.append(min(file, encode(pixels, **own), key=len) if own else file)
    return b"".join(files)


def load_images(media: bytes) -> list[np.ndarray]:
    images, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        images.append(decode(media[at:end]))
        at = end
    return images


def image_bytes(pixels: np.ndarray) -> bytes:
    return np.stack([pixels >> s & 0xFF for s in (16, 8, 0)], axis=-1).astype(np.uint8).tobytes()


def feature(samples: np.ndarray) -> str:
    """Rows, mean sample in thousandths, and a 64-bit hash: which 64ths are brighter than the mean."""
    total = int(samples.sum(dtype=np.int64))
    cuts = np.arange(65) * len(samples) // 64
    sums = np.concatenate(([0], np.cumsum(samples, dtype=np.int64)))
    part = sums[cuts[1:]] - sums[cuts[:-1]]
    bright = part * len(samples) > total * (cuts[1:] - cuts[:-1])
    mark = int.from_bytes(np.packbits(bright).tobytes(), "big")
    return f"{len(samples) // ROW}:{1000 * total // len(samples)}:{mark:016x}"


_STORED = "n_bytes long, media binary"
_READ = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's padded payload as lossless WebP, as a written table.

    Null is the empty text, whose payload is one row of bytes 255. Other columns are
    not read; equal texts have equal media.
    """

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, media = [], []
            for text in frame["__text"]:
                size, payload = pad_payload(text)
                sizes.append(size)
                media.append(store_payload(payload))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": sizes, "media": media})

    id_type = docs.schema[id_column].dataType.simpleString()
    named = docs.selectExpr(f"`{id_column}` as doc_id", f"`{text_column}` as __text")
    return written(named.mapInPandas(store, f"doc_id {id_type}, {_STORED}"), "webp-media")


def read_media(stored: DataFrame) -> DataFrame:
    """Decode a media table and describe what was read back."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for media in frame["media"]:
                payload = b"".join(image_bytes(i) for i in load_images(media))
                rows.append(
                    (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-32:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        feature(np.frombuffer(payload, np.uint8)),
                    )
                )
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")[1:]])
            out.insert(0, "n_bytes", frame["n_bytes"])
            out.insert(0, "doc_id", frame["doc_id"])
            yield out

    id_type = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInPandas(read, f"doc_id {id_type}, {_READ}")


def op10_webp(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_media(store_texts(docs).select(F.col("doc_id"), "n_bytes", "media"))
