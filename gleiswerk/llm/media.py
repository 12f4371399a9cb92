"""Media columns: lossless WebP, written and read back as pixel arrays.

``decode`` reads lossless pictures of the published format whole: prefix codes
(simple and normal), several code groups, back-references, the colour cache,
and the predictor, cross-colour, subtract-green and palette transforms.

``encode`` writes ARGB values with prefix codes of the picture's own and
back-references, and with a colour cache, several code groups and each transform
where these take fewer bits. ``encode_grey`` writes 8-bit samples as a grey
picture 192 wide. Samples beyond one picture's height go into further pictures;
a stored value is these files in a row, each of which tells its own size.

Defined results: null is the empty text, one row of blanks. Rows with one
doc_id are stored each for itself; equal texts give equal bytes and values. A
null doc_id stays null; an empty table gives an empty one. Other columns are
ignored.
"""

from __future__ import annotations

import copy
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mix, record_batch, table, text_rows

WIDTH, MAX_HEIGHT = 192, 16384
#: Fixed values of the format: the order in which lengths of code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Bits that follow a stored length: of 16 (again), 17 and 18 (zeros).
LENGTH_EXTRA = (0,) * 16 + (2, 3, 7)
LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
#: Near distances first: by length, then by column, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# -- bits and prefix codes --------------------------------------------------------


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return (int.from_bytes(self.data[a : a + (n + 14) // 8], "little") >> (self.at & 7)) & ((1 << n) - 1)


#: Each 15 bits in reverse.
REVERSED = np.zeros(1 << 15, np.int64)
for _k in range(15):
    REVERSED |= (np.arange(1 << 15) >> _k & 1) << (14 - _k)
_REVERSED = REVERSED.tolist()


@lru_cache(16)
def reversed_bits(n: int) -> np.ndarray:
    """Each n bits in reverse."""
    return REVERSED[: 1 << n] >> 15 - n


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of canonical lengths, first bit lowest."""
    codes = np.zeros(len(lengths), np.int64)
    used = lengths.nonzero()[0]
    n = lengths[used]
    order = n.argsort(kind="stable")
    used, n = used[order], n[order]
    share = 1 << 15 - n
    before = share.cumsum() - share
    codes[used] = REVERSED[before & (1 << 15) - 1]
    return codes


def short_codes(lengths: list[int]) -> list[int]:
    """``canonical`` of the few lengths of up to 7 bits that lengths are stored by."""
    codes, at = [0] * len(lengths), 0
    for n, k in sorted((n, k) for k, n in enumerate(lengths) if n):
        codes[k] = _REVERSED[at]
        at += 1 << 15 - n
    return codes


def short_table(lengths: list[int]) -> list[int]:
    """As ``Code.table``, over 7 bits."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) < 2:
        return [(used[0] if used else 0) << 4] * 128
    if sum(128 >> lengths[s] for s in used) != 128:
        raise ValueError("the prefix code is not complete")
    out, codes = [0] * 128, short_codes(lengths)
    for s in used:
        n = lengths[s]
        out[codes[s] :: 1 << n] = [s << 4 | n] * (128 >> n)
    return out


class Code:
    """A prefix code as a table over its longest code's bits: symbol * 16 + length."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        self.only = (int(used[0]) if len(used) else 0) if len(used) < 2 else None
        if self.only is not None:
            self.mask, self.entries = 0, np.array([self.only << 4])
            return
        n = lengths[used]
        order = n.argsort(kind="stable")
        used, n = used[order], n[order]
        most = int(n[-1])
        share = 1 << most - n
        if int(share.sum()) != 1 << most:
            raise ValueError("the prefix code is not complete")
        self.mask = (1 << most) - 1
        self.entries = (used << 4 | n).repeat(share).take(reversed_bits(most))

    @cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()


@lru_cache(256)
def one_code(symbol: int) -> Code:
    return Code(np.arange(256) == symbol)


def read_code(bits: Bits, size: int) -> Code:
    head = bits.peek(19)
    if head & 1:  # one or two symbols
        n = 11 if head & 4 else 4
        first, second = head >> 3 & (1 << n - 3) - 1, head >> n & 255
        bits.at += n + 8 if head & 2 else n
        if not head & 2:
            return one_code(first)
        lengths = np.zeros(256, np.int64)
        lengths[[first, second]] = 1
        return Code(lengths)
    n = 4 + (head >> 1 & 15)
    bits.at += 5
    stored = bits.read(3 * n)
    of_lengths = [0] * 19
    for k in range(n):
        of_lengths[LENGTH_ORDER[k]] = stored >> 3 * k & 7
    table = short_table(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    stored, p = bits.peek(14 * min(size, 80)), 0
    found: list[int] = []
    last = 8
    while len(found) < size and left:
        if p > 14 * 79:
            bits.at += p
            stored, p = bits.peek(14 * 80), 0
        left -= 1
        e = table[stored >> p & 127]
        p += e & 15
        s = e >> 4
        if s < 16:
            found.append(s)
            last = s or last
        elif s == 16:
            found += [last] * (3 + (stored >> p & 3))
            p += 2
        elif s == 17:
            found += [0] * (3 + (stored >> p & 7))
            p += 3
        else:
            found += [0] * (11 + (stored >> p & 127))
            p += 7
    bits.at += p
    return Code(np.array(found[:size]))


def read_group(bits: Bits, cache_bits: int) -> list[Code]:
    green = LITERALS + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0)
    return [read_code(bits, n) for n in (green, 256, 256, 256, DISTANCE_CODES)]


#: Extra bits of each length or distance code, and the value where they are zero.
EXTRA = [max(0, (c - 2) >> 1) for c in range(DISTANCE_CODES)]
_EXTRA = np.array(EXTRA)
FIRST = [c + 1 if c < 4 else ((2 + (c & 1)) << EXTRA[c]) + 1 for c in range(DISTANCE_CODES)]
_FIRST = np.array(FIRST)
STEPS = [(k, v, (1 << k) - 1) for k, v in zip(EXTRA, FIRST, strict=True)]


@lru_cache(64)
def near_distances(width: int) -> list[int]:
    """The distance of each code of its own, from 1."""
    return [0, *(max(1, x + y * width) for x, y in NEAR)]


@lru_cache(64)
def near_array(width: int) -> np.ndarray:
    return np.array(near_distances(width))


# -- pictures of codes --------------------------------------------------------------


def bit_windows(data: bytes) -> np.ndarray:
    """The 16 bits from each bit of ``data`` on; zeros follow the end."""
    words = np.frombuffer(data + bytes(16), np.uint8).astype(np.uint32)
    words = words[:-3] | words[1:-2] << np.uint32(8) | words[2:-1] << np.uint32(16)
    return (words[:, None] >> np.arange(8, dtype=np.uint32)).astype(np.uint16).ravel()


#: Bytes whose bits are looked up at once, and the bits beyond these that a symbol may end in.
READ_BYTES, REACH = 1 << 16, 64
_OF_BYTE = np.tile(np.arange(8), READ_BYTES)
_BITS = np.arange(8 * READ_BYTES + REACH)
_COPY = 32


def symbols_in(data: bytes, size: int, at: int, green: Code, distance: Code) -> tuple[np.ndarray, ...]:
    """The symbols of one channel that begin from bit ``at`` on in ``size`` bytes: these and where each ends; which of them are copies, and the lengths and distance values of those."""
    words = np.ndarray((size + REACH // 8,), "<u4", data[: size + REACH // 8 + 3].ljust(size + REACH // 8 + 3, b"\0"), 0, (1,)).astype(np.int64)
    index = words[:size].repeat(8)
    index >>= _OF_BYTE[: 8 * size]
    index &= green.mask
    # each bit is read as if a symbol began there; those are kept that follow from the first
    symbols = green.entries >> 4
    sizes = green.entries & 15
    long = (symbols >= LITERALS).nonzero()[0]
    sizes[long] += _EXTRA[symbols[long] - LITERALS] + _COPY
    sizes = sizes.astype(np.uint8).take(index)
    end = 8 * size
    ends = _BITS[: end + REACH].copy()
    ends[:end] += sizes
    copies = (sizes >= _COPY).nonzero()[0]
    p = ends.take(copies) - _COPY
    far = (words.take(p >> 3) >> (p & 7)) & distance.mask
    ends[copies] = p + ((distance.entries & 15) + _EXTRA[distance.entries >> 4]).take(far)
    twice = ends.take(ends)
    steps = memoryview(twice.take(twice))
    found: list[int] = []
    add = found.append
    while at < end:
        add(at)
        at = steps[at]
    four = np.empty((len(found), 4), np.int64)
    four[:, 0] = found
    four[:, 2] = twice.take(four[:, 0])
    four[:, 1::2] = ends.take(four[:, ::2])
    own = four.ravel()
    own = own[: own.searchsorted(end)]
    entries = green.entries.take(index.take(own))
    symbols = entries >> 4
    which = (symbols >= LITERALS).nonzero()[0]
    code = symbols[which] - LITERALS
    p = own[which] + (entries[which] & 15)
    more = _EXTRA[code]
    runs = _FIRST[code] + ((words.take(p >> 3) >> (p & 7)) & (1 << more) - 1)
    p += more
    far = distance.entries.take((words.take(p >> 3) >> (p & 7)) & distance.mask)
    p += far & 15
    far >>= 4
    fars = _FIRST[far] + ((words.take(p >> 3) >> (p & 7)) & (1 << _EXTRA[far]) - 1)
    return symbols, ends.take(own), which, runs, fars


def read_green(bits: Bits, green: Code, distance: Code, width: int, n: int) -> np.ndarray:
    """n green values, of a picture whose other channels take no bits and which has no colour cache."""
    filled, parts = 0, []
    while filled < n:
        base, left = bits.at >> 3, n - filled
        size = min(READ_BYTES, 9 * left + 1, len(bits.data) - base)  # a pixel or copy has less than 9 bytes
        if size <= 0:
            raise ValueError("the picture ends early")
        symbols, ends, copies, runs, fars = symbols_in(bits.data[base : base + size + REACH], size, bits.at & 7, green, distance)
        sizes = np.ones(len(symbols), np.int64)
        sizes[copies] = runs
        after = sizes.cumsum()
        last = int(after.searchsorted(left))
        if last < len(after):
            if after[last] > left:
                raise ValueError("a reference leaves the picture")
            symbols, sizes = symbols[: last + 1], sizes[: last + 1]
            copies = copies[: copies.searchsorted(last, "right")]
            fars = fars[: len(copies)]
        last = len(symbols) - 1
        filled += int(after[last])
        bits.at = 8 * base + int(ends[last])
        back = np.zeros(len(symbols), np.int64)
        back[copies] = np.where(fars > len(NEAR), fars - len(NEAR), near_array(width)[np.minimum(fars, len(NEAR))])
        parts.append((symbols.repeat(sizes), back.repeat(sizes)))
    if bits.at > 8 * len(bits.data):
        raise ValueError("the picture ends early")
    values, back = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts, strict=True))
    # each pixel comes from one of a literal, through any number of copies
    source = np.arange(n) - back
    if source.min() < 0:
        raise ValueError("a reference leaves the picture")
    while True:
        source = source.take(source)
        further = source.take(source)
        if (further == source).all():
            return values.take(source)
        source = further


def read_green_by_groups(bits: Bits, groups: list[list[Code]], of_pixel: memoryview, width: int, n: int) -> np.ndarray:
    """As ``read_green``, of a picture of several groups of codes."""
    base = bits.at >> 3
    data = bits.data[base : base + 9 * n + 16]
    windows = memoryview(bit_windows(data))
    tables = [(g[0].table, g[0].mask, g[4].table, g[4].mask) for g in groups]
    near, own, steps, literals = near_distances(width), len(NEAR), STEPS, LITERALS << 4
    p, at, last = bits.at & 7, 0, -1
    out = bytearray()
    add = out.append
    try:
        while at < n:
            group = of_pixel[at]
            if group != last:
                table, mask, far_table, far_mask = tables[group]
                last = group
            e = table[windows[p] & mask]
            p += e & 15
            if e < literals:
                add(e >> 4)
                at += 1
                continue
            k, run, rest = steps[(e >> 4) - 256]
            if k:
                run += windows[p] & rest
                p += k
            e = far_table[windows[p] & far_mask]
            p += e & 15
            k, far, rest = steps[e >> 4]
            if k:
                far += (windows[p] if k < 17 else windows[p] | windows[p + 16] << 16) & rest
                p += k
            first = at - (near[far] if far <= own else far - own)
            at += run
            if first < 0 or at > n:
                raise ValueError("a reference leaves the picture")
            far = len(out) - first
            out += out[first : first + run] if far >= run else (out[first:] * (run // far + 1))[:run]
    except IndexError:
        p = 8 * len(data) + 1
    if p > 8 * len(data):
        raise ValueError("the picture ends early")
    bits.at = base * 8 + p
    return np.frombuffer(out, np.uint8).astype(np.int64)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values of a picture of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    of_pixel, n_groups, n = None, 1, width * height
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        of_block = read_pixels(bits, across, -(-height >> block), False) >> 8 & 0xFFFF
        n_groups = int(of_block.max()) + 1
        lines = of_block.astype(np.uint16).reshape(-1, across).repeat(1 << block, 1)[:, :width]
        of_pixel = memoryview(lines.repeat(1 << block, 0)[:height].ravel())
    groups = [read_group(bits, cache_bits) for _ in range(n_groups)]
    rests = {tuple(c.only for c in g[1:4]) for g in groups}
    if not cache_bits and len(rests) == 1 and None not in (rest := rests.pop()):
        rest = rest[2] << 24 | rest[0] << 16 | rest[1]
        green, distance = groups[0][0], groups[0][4]
        if n_groups > 1:
            return rest | read_green_by_groups(bits, groups, of_pixel, width, n) << 8
        if green.only is None:
            return rest | read_green(bits, green, distance, width, n) << 8
        if green.only < LITERALS:
            return np.full(n, rest | green.only << 8, np.int64)
    # a pixel or copy has less than 9 bytes
    base = bits.at >> 3
    windows = memoryview(bit_windows(bits.data[base : base + 9 * n + 16]))
    p, end = bits.at & 7, len(windows) - 104
    out: list[int] = []
    cache = [0] * (1 << cache_bits if cache_bits else 0)
    shift = 32 - cache_bits
    stored = 0
    last = None
    left = n
    while left > 0:
        if of_pixel is not None or last is None:
            group = groups[of_pixel[n - left] if of_pixel is not None else 0]
            if group is not last:
                last = group
                green, red, blue, alpha, distance = ((c.table, c.mask) for c in group)
                table, mask = green
                plain = None not in [c.only for c in group[1:4]]
                rest = group[3].table[0] >> 4 << 24 | group[1].table[0] >> 4 << 16 | group[2].table[0] >> 4 if plain else 0
        if p > end:
            raise ValueError("the picture ends early")
        e = table[windows[p] & mask]
        p += e & 15
        s = e >> 4
        if s < LITERALS:
            if plain:
                out.append(rest | s << 8)
            else:
                r = red[0][windows[p] & red[1]]
                p += r & 15
                b = blue[0][windows[p] & blue[1]]
                p += b & 15
                a = alpha[0][windows[p] & alpha[1]]
                p += a & 15
                out.append(a >> 4 << 24 | r >> 4 << 16 | s << 8 | b >> 4)
            left -= 1
        elif s < LITERALS + LENGTH_CODES:
            k = EXTRA[s - LITERALS]
            run = FIRST[s - LITERALS] + (windows[p] & (1 << k) - 1)
            p += k
            e = distance[0][windows[p] & distance[1]]
            p += e & 15
            k = EXTRA[e >> 4]
            far = FIRST[e >> 4] + ((windows[p] | windows[p + 16] << 16) & (1 << k) - 1)
            p += k
            if far > len(NEAR):
                far -= len(NEAR)
            else:
                far = near_distances(width)[far]
            at = n - left
            if far > at or run > left:
                raise ValueError("a reference leaves the picture")
            if far >= run:
                out += out[at - far : at - far + run]
            else:
                out += (out[at - far :] * (run // far + 1))[:run]
            left -= run
        else:
            at = n - left
            for v in out[stored:at]:
                cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> shift] = v
            stored = at
            out.append(cache[s - LITERALS - LENGTH_CODES])
            left -= 1
    if p > end:
        raise ValueError("the picture ends early")
    bits.at = base * 8 + p
    return np.array(out, np.int64)


# -- transforms ----------------------------------------------------------------------


def channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> 24 & 255, argb >> 16 & 255, argb >> 8 & 255, argb & 255], -1)


def joined(parts: np.ndarray) -> np.ndarray:
    p = parts.astype(np.int64) & 255
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def predicted(mode: int, left: list[int], top: list[int], above_right: list[int], above_left: list[int]) -> list[int]:
    """What a mode expects from the neighbours, by channel."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return above_right
    if mode == 4:
        return above_left
    if mode == 5:
        return half(half(left, above_right), top)
    if mode == 6:
        return half(left, above_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(above_left, top)
    if mode == 9:
        return half(top, above_right)
    if mode == 10:
        return half(half(left, above_left), half(top, above_right))
    if mode == 11:
        to_left = sum(abs(t - d) for t, d in zip(top, above_left, strict=True))
        to_top = sum(abs(x - d) for x, d in zip(left, above_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clip(x + t - d) for x, t, d in zip(left, top, above_left, strict=True)]
    if mode == 13:
        return [clip(m + int((m - d) / 2)) for m, d in zip(half(left, top), above_left, strict=True)]
    return [255, 0, 0, 0]


def predicted_one(mode: int, left: int, top: int, above_right: int, above_left: int) -> int:
    """``predicted`` of a single channel that is 0 in a blank picture."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 11:
        return left if abs(top - above_left) < abs(left - above_left) else top
    if mode == 0 or mode > 13:
        return 0
    return predicted(mode, [left], [top], [above_right], [above_left])[0]


def undo_predictor(pixels: np.ndarray, width: int, block: int, modes: np.ndarray) -> np.ndarray:
    across = -(-width >> block)
    modes = (modes >> 8 & 255).tolist()
    if not (pixels & 0xFFFF00FF).any():  # differences of green alone: red and blue stay 0, alpha 255
        grey = (pixels >> 8).reshape(-1, width).tolist()
        before: list[int] = []
        for y, line in enumerate(grey):
            now = before[0] if y else 0
            for x, diff in enumerate(line):
                if y and x:
                    now = predicted_one(modes[(y >> block) * across + (x >> block)], now, before[x], before[x + 1] if x + 1 < width else line[0], before[x - 1])
                line[x] = now = diff + now & 255
            before = line
        return 0xFF000000 | np.array(grey, np.int64).ravel() << 8
    rows = channels(pixels).reshape(-1, width, 4).tolist()
    for y, row in enumerate(rows):
        for x, rest in enumerate(row):
            if not y:
                expect = row[x - 1] if x else [255, 0, 0, 0]
            elif not x:
                expect = rows[y - 1][0]
            else:
                above = rows[y - 1]
                expect = predicted(modes[(y >> block) * across + (x >> block)], row[x - 1], above[x], above[x + 1] if x + 1 < width else row[0], above[x - 1])
            row[x] = [(a + b) & 255 for a, b in zip(rest, expect, strict=True)]
    return joined(np.array(rows, np.int64).reshape(-1, 4))


def signed(x: np.ndarray) -> np.ndarray:
    return (x + 128 & 255) - 128


def undo_cross_colour(pixels: np.ndarray, width: int, block: int, factors: np.ndarray) -> np.ndarray:
    at = np.arange(len(pixels))
    own = channels(factors)[(at // width >> block) * -(-width >> block) + (at % width >> block)]
    red_to_blue, green_to_blue, green_to_red = (signed(own[:, k]) for k in (1, 2, 3))
    p = channels(pixels)
    green = signed(p[:, 2])
    p[:, 1] = p[:, 1] + (green_to_red * green >> 5) & 255
    p[:, 3] = p[:, 3] + (green_to_blue * green >> 5) + (red_to_blue * signed(p[:, 1]) >> 5) & 255
    return joined(p)


def green_only(pixels: np.ndarray) -> bool:
    """Whether red and blue are 0 and alpha 255, as in grey pictures less their green."""
    return bool((pixels & 0xFFFF00FF == 0xFF000000).all())


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    if green_only(pixels):
        return (pixels >> 8 & 255) * 0x10101 | 0xFF000000
    g = pixels >> 8 & 255
    return pixels & 0xFF00FF00 | ((pixels >> 16) + g & 255) << 16 | (pixels + g & 255)


def undo_palette(pixels: np.ndarray, width: int, palette: np.ndarray, shift: int) -> np.ndarray:
    packed = (pixels >> 8 & 255).reshape(-1, -(-width >> shift))
    x = np.arange(width)
    bits = 8 >> shift
    index = packed[:, x >> shift] >> ((x & (1 << shift) - 1) * bits) & (1 << bits) - 1
    return np.concatenate([palette, np.zeros(256, np.int64)])[index].ravel()


def decode(file: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and the ARGB values of one lossless picture."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L" or file[20] != 0x2F:
        raise ValueError("no lossless picture")
    bits = Bits(file[21 : 20 + int.from_bytes(file[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            block = bits.read(3) + 2
            data = read_pixels(bits, -(-now >> block), -(-height >> block), False)
            undo.append((undo_predictor if kind == 0 else undo_cross_colour, (now, block, data)))
        elif kind == 2:
            undo.append((undo_subtract_green, ()))
        else:
            size = bits.read(8) + 1
            palette = joined(np.cumsum(channels(read_pixels(bits, size, 1, False)), 0))
            shift = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((undo_palette, (now, palette, shift)))
            now = -(-now >> shift)
    pixels = read_pixels(bits, now, height, True)
    for f, args in reversed(undo):
        pixels = f(pixels, *args)
    return width, height, pixels


# -- writing pictures --------------------------------------------------------------------


class BitList:
    """Values of up to 31 bits, the lowest first, one after another."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.sizes: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.parts.append((np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
        self.parts.append((values, sizes))
        self.values, self.sizes = [], []

    def bytes(self) -> bytes:
        return packed([self])[0]


def packed(lists: list[BitList]) -> list[bytes]:
    """The bytes of each list."""
    none = np.zeros(0, np.int64)
    for x in lists:
        x.put_all(none, none)
    values, sizes = (np.concatenate([part[k] for x in lists for part in x.parts]) for k in (0, 1))
    counts = np.array([sum(len(part[0]) for part in x.parts) for x in lists])
    at = np.cumsum(sizes) - sizes
    begin = at[np.cumsum(counts) - counts]
    bits = np.diff(begin, append=at[-1] + sizes[-1])
    n_words = bits + 31 >> 5
    first_word = np.cumsum(n_words) - n_words
    at += np.repeat(32 * first_word - begin, counts)  # each list begins with a word
    word = at >> 5
    at &= 31
    values <<= at  # values of up to 31 bits reach into the next word
    first = np.concatenate([[0], (word[1:] != word[:-1]).nonzero()[0] + 1])
    either = np.bitwise_or.reduceat(values, first)
    word = word[first]
    words = np.zeros(int(n_words.sum()) + 2, np.uint32)
    words[word] = either & 0xFFFFFFFF
    words[word + 1] |= (either >> 32).astype(np.uint32)
    data = words.astype("<u4").tobytes()
    return [data[i : i + n] for i, n in zip((4 * first_word).tolist(), (bits + 7 >> 3).tolist(), strict=True)]


_LOGS = np.arange(1 << 12) * np.log2(np.maximum(np.arange(1 << 12), 1))


def bits_of(counts: np.ndarray) -> np.ndarray:
    """Bits of symbols so frequent in the best code of fractional lengths, by the last axis."""
    n = counts.sum(-1)
    each = _LOGS[counts] if counts.max() < len(_LOGS) else counts * np.log2(np.maximum(counts, 1))
    return n * np.log2(np.maximum(n, 1)) - each.sum(-1)


def floor_log2(x: np.ndarray) -> np.ndarray:
    """Of positive whole numbers under 2**53, or powers of two; -1023 of 0."""
    return (x.astype(np.float64).view(np.int64) >> 52) - 1023


def huffman_lengths(weights: list[int], most: int) -> list[int]:
    """Code lengths of at most ``most`` bits; small weights are raised until they fit."""
    n, floor = len(weights), 0
    order = sorted(range(n), key=weights.__getitem__)
    none = float("inf")
    while True:
        leaves = [max(weights[i], floor) for i in order] if floor else [weights[i] for i in order]
        leaves.append(none)
        nodes = [none] * n  # what two are joined to: leaves and nodes are both in rising order
        above_leaf, above_node = [0] * n, [0] * n
        i = j = 0
        for k in range(n - 1):
            if leaves[i] <= nodes[j]:
                x = leaves[i]
                above_leaf[i] = k
                i += 1
            else:
                x = nodes[j]
                above_node[j] = k
                j += 1
            if leaves[i] <= nodes[j]:
                x += leaves[i]
                above_leaf[i] = k
                i += 1
            else:
                x += nodes[j]
                above_node[j] = k
                j += 1
            nodes[k] = x
        depth = [0] * n
        for k in range(n - 3, -1, -1):
            depth[k] = depth[above_node[k]] + 1
        if max(depth) < most:
            out = [0] * n
            for i, k in zip(order, above_leaf, strict=True):
                out[i] = depth[k] + 1
            return out
        floor = 2 * floor or max(2, sum(weights) >> most + 1)


def put_one(out: BitList, symbol: int) -> None:
    """Writes a code of one symbol, which takes no bits."""
    out.put(1 | (symbol > 1) << 2 | symbol << 3, 11 if symbol > 1 else 4)


def put_code(out: BitList, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the best prefix code of symbols so frequent; its lengths and codes."""
    used = counts.nonzero()[0]
    lengths = np.zeros(len(counts), np.int64)
    if not len(used) or len(used) == 1 and used[0] < 256:
        put_one(out, int(used[0]) if len(used) else 0)
        return lengths, lengths
    if len(used) == 2 and used[1] < 256:
        wide = int(used[0] > 1)
        out.put(0b11 | wide << 2 | int(used[0]) << 3 | int(used[1]) << (11 if wide else 4), 19 if wide else 12)
        lengths[used] = 1
        return lengths, canonical(lengths)
    n = int(counts.sum())
    # short codes make the reader's tables small, which is most of what a small picture takes
    lengths[used] = huffman_lengths(counts[used].tolist(), 11 if n < 1 << 14 and len(used) < 1 << 10 else 15) if len(used) > 1 else 1
    # lengths in a row: 16 repeats the last one, 17 and 18 are zeros; zeros at the end are left out
    tokens: list[int] = []
    rests: list[tuple[int, int]] = []  # what follows a token, by its place
    own = lengths[: int(used[-1]) + 1]
    starts = [0, *((own[1:] != own[:-1]).nonzero()[0] + 1).tolist(), len(own)]
    for n, size in zip(own[starts[:-1]].tolist(), map(sub, starts[1:], starts[:-1]), strict=True):
        if size < 3:
            tokens += (n,) * size
            continue
        if n:
            tokens.append(n)
            size -= 1
        while size > 2:
            s, low, high = (16, 3, 6) if n else (17, 3, 10) if size < 11 else (18, 11, 138)
            k = min(size, high)
            rests.append((len(tokens), k - low))
            tokens.append(s)
            size -= k
        tokens += [n] * size
    if len(tokens) == 1:  # the least number that can be told is 2
        tokens.append(0)
    of_counts = Counter(tokens)
    of_used = [s for s in range(19) if of_counts[s]]
    of_lengths = [0] * 19
    for s, n in zip(of_used, huffman_lengths([of_counts[s] for s in of_used], 7) if len(of_used) > 1 else [1], strict=True):
        of_lengths[s] = n
    stored = [of_lengths[s] for s in LENGTH_ORDER]
    while len(stored) > 4 and not stored[-1]:
        stored.pop()
    k = max(2, (len(tokens) - 2).bit_length() + 1 & ~1)
    codes = short_codes(of_lengths)
    sizes = of_lengths if len(of_used) > 1 else [0] * 19
    out.values += [len(stored) - 4 << 1, *stored, 1 | (k - 2) // 2 << 1, len(tokens) - 2]
    before = len(out.values)
    out.values += map(codes.__getitem__, tokens)
    for i, rest in rests:
        out.values[before + i] |= rest << sizes[tokens[i]]
    out.sizes += [5, *[3] * len(stored), 4, k]
    out.sizes += map([n + more for n, more in zip(sizes, LENGTH_EXTRA, strict=True)].__getitem__, tokens)
    if len(used) == 1:
        lengths[:] = 0  # no bits
    return lengths, canonical(lengths)


def prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of lengths or distances, how many bits follow, and these."""
    code = np.searchsorted(_FIRST, values, "right") - 1
    return code, _EXTRA[code], values - _FIRST[code]


@lru_cache(64)
def near_codes(width: int) -> np.ndarray:
    """The code of each distance of up to 8 lines, 0 where it has none of its own."""
    out = np.zeros(8 * width + 16, np.int64)
    for k in range(len(NEAR), 0, -1):
        out[near_distances(width)[k]] = k
    return out


def distance_values(far: np.ndarray, width: int) -> np.ndarray:
    near = near_codes(width)
    own = near[np.minimum(far, len(near) - 1)]
    return np.where((own > 0) & (far < len(near)), own, far + len(NEAR))


#: Pixels of a copy that are compared at once.
AT_ONCE = 16
#: Parts of a bit in which costs are counted: whole numbers add up alike in any order.
PARTS = 1 << 10
#: What a copy takes, about, by the whole logarithm of its distance.
COPY_COST = np.array([int((7.5 + max(0, k - 3)) * PARTS) for k in range(32)])
#: What the head of a code of distances takes, about.
FAR_HEAD_COST = 100 * PARTS
RUN_COST = np.array([0, *((k.bit_length() - 1) * PARTS for k in range(1, AT_ONCE + 1))])
LONGEST, FARTHEST = 4096, (1 << 20) - len(NEAR)
#: Pictures and pixels that are looked through together; a larger picture is looked through alone.
TOGETHER, PIXELS_TOGETHER = 1 << 7, 1 << 15


def literal_costs(counts: np.ndarray) -> np.ndarray:
    """What each symbol takes, about, of those so frequent, by the last axis."""
    return np.rint(PARTS * np.log2(counts.sum(-1, keepdims=True) / np.maximum(counts, 1))).astype(np.int64)


def find_copies(near: np.ndarray, colours: np.ndarray | None, cost: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pixels repeat earlier ones of their picture so that a copy takes less than literals do: starts, lengths and distances.

    ``near``: bytes that are alike where pixels are, the pixels themselves where there are no ``colours``. ``bounds``
    of several pictures are those of TOGETHER and PIXELS_TOGETHER. Each pixel is compared with the nearest earlier
    place that has the same five pixels; a copy begins one pixel later if that saves more.
    """
    n, several = len(near), len(bounds) - 2
    none = np.zeros(0, np.int64)
    if n < 8:
        return none, none, none
    words = np.ndarray((n + 8,), "<u8", near.tobytes() + bytes(AT_ONCE), 0, (1,)).copy()
    size = n.bit_length()
    order = words[: n - 4] << np.uint64(max(24, size))
    order >>= np.uint64(max(24, size) - size)
    order |= np.arange(n - 4, dtype=np.uint64)
    if several:  # the picture goes before the pixels
        sizes = np.diff(bounds)
        picture = np.repeat(np.arange(several + 1), sizes)
        inside = np.ones(n, bool)
        inside[(bounds[1:, None] - np.arange(1, 5)).ravel()] = False
        order = order[inside[: n - 4]]
        order |= np.repeat(np.arange(several + 1, dtype=np.uint64) << np.uint64(40 + size), sizes - 4)
    order.sort()
    place = (order & np.uint64((1 << size) - 1)).view(np.int64)
    order >>= np.uint64(size)
    same = np.flatnonzero(order[1:] == order[:-1])
    at, source = place[same + 1], place[same]
    far = at - source
    left = (bounds[1:][picture[at]] if several else n) - at
    differ = words[at] ^ words[source]
    run = floor_log2(differ & -differ) >> 3
    long = np.flatnonzero(run < 0)
    if len(long):
        differ = words[at[long] + 8] ^ words[source[long] + 8]
        more = floor_log2(differ & -differ) >> 3
        more[more < 0] = 8
        run[long] = 8 + more
    run = np.minimum(run, left)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(cost, out=total[1:])
    saved = total[at + run] - total[at] - COPY_COST[floor_log2(far)] - RUN_COST[run]
    good = np.flatnonzero((saved > 0) & (far <= FARTHEST))
    if not len(good):
        return none, none, none
    gain, which = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    gain[at[good]], which[at[good]] = saved[good], good
    begins = gain[:-1] > 0
    begins &= gain[:-1] >= gain[1:]
    at = np.flatnonzero(begins)
    which = which[at]
    run, far, left = run[which], far[which], (left[which] if several else n - at)
    # the next that may follow each; below 0: there are more pixels to compare
    before = np.arange(len(at) + 1).repeat(np.diff(at, prepend=-1, append=n))  # how many begin before each pixel
    to = np.append(before[at + run], -1)
    to[:-1][(run == AT_ONCE) | (run > 2) & (colours is not None)] = -1
    raw, unit = (near.tobytes(), 1) if colours is None else (colours.astype("<u4").tobytes(), 4)
    steps, visited, k = memoryview(to), [], 0
    add = visited.append
    while True:
        add(k)
        step = steps[k]
        if step < 0:
            if k == len(at):
                break
            length, back, i, step, most = 0, unit * int(far[k]), unit * int(at[k]), AT_ONCE, min(LONGEST, int(left[k]))
            while step:
                j = i + unit * length
                if length + step <= most and raw[j : j + unit * step] == raw[j - back : j - back + unit * step]:
                    length += step
                    step *= 2
                else:
                    step //= 2
            run[k] = length
            step = int(before[at[k] + max(1, length)])
        k = step
    kept = np.array(visited[:-1])
    kept = kept[run[kept] > 2]
    starts = at[kept]
    if several:
        enough = np.bincount(picture[starts], gain[starts], several + 1) >= FAR_HEAD_COST
        kept = kept[enough[picture[starts]]]
    elif gain[starts].sum() < FAR_HEAD_COST:
        return none, none, none
    return at[kept], run[kept], far[kept]


def cache_hits(pixels: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in the colour cache, and whether it lies there."""
    slot = (pixels * CACHE_FACTOR & 0xFFFFFFFF) >> 32 - cache_bits
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    hit = np.zeros(len(pixels), bool)
    there = pixels[order]
    hit[order[1:]] = there[1:] == there[:-1]  # one colour has one place
    return slot, hit


CACHES = (2, 5, 8)
#: Bits that a used symbol takes in the head, about.
HEAD_BITS = 5.0


class Symbols:
    """A picture as literals, copies and places in the colour cache."""

    cache_bits, alphabet = 0, LITERALS + LENGTH_CODES
    #: Green or length; then red, blue and alpha, or the rest of a length, the distance and its rest.
    at: np.ndarray
    green: np.ndarray
    copy: np.ndarray
    literal: np.ndarray
    run_size: np.ndarray
    run_rest: np.ndarray
    distance: np.ndarray
    far_size: np.ndarray
    far_rest: np.ndarray
    others: np.ndarray | None = None

    def cached(self, pixels: np.ndarray, cache_bits: int) -> Symbols:
        """With a colour cache, which holds the colours met last."""
        slot, hit = cache_hits(pixels, cache_bits)
        at = self.at[self.literal]
        hit = hit[at]
        out = copy.copy(self)
        out.cache_bits, out.alphabet = cache_bits, self.alphabet + (1 << cache_bits)
        out.green = self.green.copy()
        out.green[self.literal[hit]] = self.alphabet + slot[at[hit]]
        out.literal = self.literal[~hit]
        out.others = None if self.others is None else self.others[~hit]
        return out

    def counts(self) -> list[np.ndarray]:
        others = [] if self.others is None else [np.bincount(self.others[:, k], minlength=256) for k in range(3)]
        return [np.bincount(self.green, minlength=self.alphabet), *others]

    def bits(self) -> float:
        """How many bits this takes, about."""
        counts = self.counts()
        if len(self.distance):
            counts.append(np.bincount(self.distance, minlength=DISTANCE_CODES))
        return sum(float(bits_of(c)) + HEAD_BITS * np.count_nonzero(c) for c in counts) + float(self.run_size.sum() + self.far_size.sum())


def symbols_of(green: np.ndarray, width: int, copies: tuple[np.ndarray, np.ndarray, np.ndarray], bounds: np.ndarray) -> Iterator[Symbols]:
    """Each picture's symbols, of one channel."""
    starts, lengths, distances = copies
    edge = np.zeros(len(green) + 1, np.int8)
    edge[starts + lengths] = -1
    edge[starts] += 1
    covered = np.cumsum(edge[:-1], dtype=np.int8)
    covered[starts] = 0
    at = np.flatnonzero(covered == 0)
    copied = at.searchsorted(starts)
    length, run_size, run_rest = prefix(lengths)
    distance, far_size, far_rest = prefix(distance_values(distances, width))
    symbols = green[at].astype(np.int64)
    symbols[copied] = LITERALS + length
    literal = np.flatnonzero(symbols < LITERALS)
    of_at, of_copy = at.searchsorted(bounds), starts.searchsorted(bounds)
    of_literal = of_at - of_copy
    parts = zip(bounds.tolist(), of_at.tolist(), of_at[1:].tolist(), of_copy.tolist(), of_copy[1:].tolist(), of_literal.tolist(), of_literal[1:].tolist(), strict=False)
    for first, a, b, c, d, e, f in parts:
        out = Symbols()
        out.at, out.green, out.copy, out.literal = at[a:b] - first, symbols[a:b], copied[c:d] - a, literal[e:f] - a
        out.run_size, out.run_rest, out.distance, out.far_size, out.far_rest = (x[c:d] for x in (run_size, run_rest, distance, far_size, far_rest))
        yield out


def groups_of(symbols: Symbols, width: int, height: int) -> tuple[int, np.ndarray] | None:
    """The size of blocks, and the code group of each, where several groups take fewer bits than one."""
    block = 5
    while (height >> block) * (width >> block) > 1024:
        block += 1
    if height < 32:  # the heads of more codes take more than they save
        return None
    across, down = -(-width >> block), -(-height >> block)
    n, size = across * down, symbols.alphabet
    if n < 4 or block > 9:
        return None
    of_symbol = (symbols.at // width >> block) * across + (symbols.at % width >> block)
    counts = np.bincount(of_symbol * size + symbols.green, minlength=n * size).reshape(n, size)
    exact = counts.astype(np.float64)
    groups, before = np.arange(n) * 4 // n, None
    for _ in range(6):
        p = (groups == np.arange(4)[:, None]).astype(np.float64) @ exact + 0.05
        groups = (exact @ np.log2(p.sum(-1, keepdims=True) / p).T).argmin(-1)
        if before is not None and (groups == before).all():
            break
        before = groups
    groups = np.unique(groups, return_inverse=True)[1]
    sums = np.zeros((groups.max() + 1, size), np.int64)
    np.add.at(sums, groups, counts)
    several = float(bits_of(sums).sum()) + HEAD_BITS * np.count_nonzero(sums) + 40 * len(sums) + 2 * n
    one = counts.sum(0)
    return (block, groups) if len(sums) > 1 and several < float(bits_of(one)) + HEAD_BITS * np.count_nonzero(one) else None


def put_pixels(out: BitList, pixels: np.ndarray, width: int, main: bool, best: Symbols | None = None) -> None:
    """Writes a picture of codes: with copies, a colour cache and several code groups where these take fewer bits. ``best``: its symbols, if they are known; ``pixels`` are its green alone then."""
    height = len(pixels) // width
    if best is None:
        others = None if green_only(pixels) else channels(pixels)[:, [1, 3, 0]]
        green = pixels >> 8 & 255
        all_channels = (green, *(() if others is None else others.T))
        cost = sum(literal_costs(np.bincount(x, minlength=256))[x] for x in all_channels)
        bounds = np.array([0, len(pixels)])
        near = green.astype(np.uint8) if others is None else mix(pixels.astype(np.uint64)).astype(np.uint8)
        best = next(symbols_of(green, width, find_copies(near, None if others is None else pixels, cost, bounds), bounds))
        if others is not None:
            best.others = others[best.at[best.literal]]
    others = best.others
    literal = best.green[best.literal]
    # of one channel, a place in the cache is a symbol as a literal is: it takes less where colours come again soon
    if others is not None or (8 * np.count_nonzero(literal[1:] == literal[:-1]) > len(literal) and bool((pixels != pixels[0]).any())):
        if pixels.dtype == np.uint8:
            pixels = 0xFF000000 | pixels.astype(np.int64) << 8
        colours = int(np.count_nonzero(np.diff(np.sort(pixels)))) + 1
        uncached, cost = best, best.bits()
        for cache_bits in CACHES:
            if 1 << cache_bits < 2 * colours:
                s = uncached.cached(pixels, cache_bits)
                if (b := s.bits()) < cost:
                    best, cost = s, b
    out.put(1 | best.cache_bits << 1 if best.cache_bits else 0, 5 if best.cache_bits else 1)
    n_groups, own = 1, None
    if main:
        several = groups_of(best, width, height)
        out.put(several is not None, 1)
        if several is not None:
            block, groups = several
            out.put(block - 2, 3)
            across = -(-width >> block)
            put_pixels(out, 0xFF000000 | groups << 8, across, False)
            n_groups, own = int(groups.max()) + 1, groups[(best.at // width >> block) * across + (best.at % width >> block)]
    # a literal has a value of each channel that differs, a copy its length (with the rest), its distance and the rest
    slots = np.ones(len(best.at), np.int64)
    slots[best.copy] = 3
    if best.others is not None:
        slots[best.literal] = 4
    first = slots.cumsum() - slots
    values, sizes = np.zeros((2, int(slots.sum())), np.int64)

    def put_values(at: np.ndarray, symbols: np.ndarray, size: int) -> None:
        lengths, codes = put_code(out, np.bincount(symbols, minlength=size))
        values[at], sizes[at] = codes[symbols], lengths[symbols]

    of_copy, of_literal = first[best.copy], first[best.literal]
    for g in range(n_groups):
        rows, copied, literals = (slice(None),) * 3 if own is None else (np.flatnonzero(own[x] == g) for x in (slice(None), best.copy, best.literal))
        put_values(first[rows], best.green[rows], best.alphabet)
        for k in range(3):
            if best.others is None:
                put_one(out, (0, 0, 255)[k])
            else:
                put_values(of_literal[literals] + k + 1, best.others[literals, k], 256)
        put_values(of_copy[copied] + 1, best.distance[copied], DISTANCE_CODES)
    values[of_copy] |= best.run_rest << sizes[of_copy]
    sizes[of_copy] += best.run_size
    values[of_copy + 2], sizes[of_copy + 2] = best.far_rest, best.far_size
    out.put_all(values, sizes)


LEVELS = np.arange(256)


# -- choosing transforms -------------------------------------------------------------------


def expected(parts: np.ndarray, width: int, mode: int) -> np.ndarray:
    """What a mode expects of each pixel below the first line, by channel (the first column's is not used)."""
    left, top, right, corner = parts[width - 1 : -1], parts[:-width], parts[1 : len(parts) - width + 1], np.concatenate([parts[:1], parts[: -width - 1]])
    if mode == 0:
        return np.broadcast_to(np.array([255, 0, 0, 0] if parts.shape[1] == 4 else [0], parts.dtype), top.shape)
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode < 10:
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return a + b >> 1
    if mode == 10:
        return (left + corner >> 1) + (top + right >> 1) >> 1
    if mode == 11:
        return np.where((abs(top - corner).sum(-1) < abs(left - corner).sum(-1))[:, None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = left + top >> 1
    over = mean - corner
    return np.clip(mean + (over + (over < 0) >> 1), 0, 255)


def neighbours_tell(parts: np.ndarray, width: int, bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether pixels of each picture, whose values are so frequent, are nearer to the one before or above than 0.7 times as they are to their mean: what is made of those may be better than the pixels."""
    sizes = np.diff(bounds)
    mean = counts @ LEVELS // sizes[:, None]
    about = (counts * np.abs(signed(LEVELS - mean[..., None]))).sum((-2, -1)) / sizes

    def apart(k: int) -> np.ndarray:
        """How far each pixel is from the one k before."""
        far = np.zeros(parts.shape, np.uint8)
        np.abs((parts[k:] - parts[:-k]).view(np.int8), out=far[:-k].view(np.int8))
        far = far[:, 0] if far.shape[1] == 1 else far.sum(-1, dtype=np.int64)
        ranges = np.stack([bounds[:-1], np.maximum(bounds[1:] - k, bounds[:-1])], 1).ravel()
        return np.add.reduceat(far, ranges, dtype=np.int64)[::2] / np.maximum(sizes - k, 1)

    out = sizes > width
    if out.any():
        out &= np.minimum(apart(1), apart(width)) <= 0.7 * about
    return out


def predict(pixels: np.ndarray, width: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """The size of blocks, the best mode of each and the differences; None where these take more bits."""
    n, height = len(pixels), len(pixels) // width
    if height < 2:
        return None
    one = green_only(pixels)
    parts = ((pixels >> 8)[:, None] if one else channels(pixels)).astype(np.uint8)
    depth = parts.shape[1]
    if not neighbours_tell(parts, width, np.array([0, n]), np.stack([np.bincount(x, minlength=256) for x in parts.T])[None]).all():
        return None

    def whole(x: np.ndarray) -> float:
        return float(sum(bits_of(c) + HEAD_BITS * np.count_nonzero(c) for c in (np.bincount(x[:, k], minlength=256) for k in range(depth))))

    plain = whole(parts)
    if min(whole(parts[k:] - parts[:-k]) for k in (1, width)) > 1.1 * plain:
        return None
    parts = parts.astype(np.int16)
    block = 4
    while -(-height >> block) * -(-width >> block) > max(1, n >> 12) and block < 9:
        block += 1
    across = -(-width >> block)
    at = np.arange(n)
    of_pixel = (at // width >> block) * across + (at % width >> block)
    blocks = int(of_pixel[-1]) + 1
    rest = np.empty((14, n, depth), np.uint8)
    rest[:, 0] = parts[0] - ([0] if one else [255, 0, 0, 0]) & 255
    rest[:, 1:width] = np.diff(parts[:width], axis=0) & 255
    bits = np.empty((14, blocks))
    base = (of_pixel[:, None] * depth + np.arange(depth)) * 256
    for mode in range(14):
        rest[mode, width:] = parts[width:] - expected(parts, width, mode) & 255
        rest[mode, width::width] = parts[width::width] - parts[:-width:width] & 255
        bits[mode] = bits_of(np.bincount((base + rest[mode]).ravel(), minlength=blocks * depth * 256).reshape(blocks, depth, 256)).sum(-1)
    modes = bits.argmin(0)
    found = rest[modes[of_pixel], at]
    if whole(found) + 4 * blocks >= plain:
        return None
    found = found.astype(np.int64)
    return block, modes, 0xFF000000 | found[:, 0] << 8 if one else joined(found)


def cross_colour(pixels: np.ndarray, width: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """The size of blocks, factors that take green from red, and green and red from blue, and what is left; None where no channel gets simpler."""
    block = 5
    across = -(-width >> block)
    at = np.arange(len(pixels))
    of_pixel = (at // width >> block) * across + (at % width >> block)
    p = channels(pixels)
    red, green, blue = (signed(p[:, k]) for k in (1, 2, 3))

    def factor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both, square = (np.bincount(of_pixel, a * x) for x in (b, a))
        return np.clip(np.round(32 * both / np.maximum(square, 1)), -128, 127).astype(np.int64)

    to_red, to_blue = factor(green, red), factor(green, blue)
    new_red = red - (to_red[of_pixel] * green >> 5)
    new_blue = blue - (to_blue[of_pixel] * green >> 5)
    from_red = factor(red, signed(new_blue & 255))
    new_blue = new_blue - (from_red[of_pixel] * red >> 5)
    out = p.copy()
    out[:, 1], out[:, 3] = new_red & 255, new_blue & 255
    bits = lambda x: float(sum(bits_of(np.bincount(x[:, k], minlength=256)) for k in (1, 3)))
    if bits(out) + 24 * len(to_red) >= bits(p):
        return None
    return block, joined(np.stack([np.full(len(to_red), 255), from_red, to_blue, to_red], -1)), joined(out)


def palette_of(pixels: np.ndarray, width: int) -> tuple[np.ndarray, int, np.ndarray] | None:
    """Up to 256 colours, the shift of the packed width, and the packed picture."""
    colours, index = np.unique(pixels, return_inverse=True)
    if len(colours) > 256:
        return None
    shift = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
    index = index.reshape(-1, width)
    packed = np.zeros((len(index), -(-width >> shift)), np.int64)
    for k in range(1 << shift):
        part = index[:, k :: 1 << shift]
        packed[:, : part.shape[1]] |= part << k * (8 >> shift)
    return colours, shift, 0xFF000000 | packed.ravel() << 8


def started(width: int, height: int, alpha: bool) -> BitList:
    out = BitList()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(alpha), 1)
    out.put(0, 3)
    return out


def _written(pixels: np.ndarray, width: int, grey: bool, transforms: str) -> BitList | None:
    """A picture's bits by transforms: palette, green, predictor, cross-colour (p, g, d, c); None where one is of no use."""
    out = started(width, len(pixels) // width, not grey and bool((pixels >> 24 != 255).any()))
    now = width
    for kind in transforms:
        if kind == "p":
            if (found := palette_of(pixels, width)) is None:
                return None
            colours, shift, pixels = found
            out.put(1 | 3 << 1 | len(colours) - 1 << 3, 11)
            put_pixels(out, joined(np.diff(channels(colours), axis=0, prepend=0)), len(colours), False)
            now = -(-width >> shift)
        elif kind == "g":
            out.put(1 | 2 << 1, 3)
            g = pixels >> 8 & 255
            pixels = pixels & 0xFF00FF00 if grey else pixels & 0xFF00FF00 | ((pixels >> 16) - g & 255) << 16 | (pixels - g & 255)
        else:
            found = predict(pixels, now) if kind == "d" else cross_colour(pixels, now)
            if found is None:
                return None
            block, data, pixels = found
            out.put(1 | (0 if kind == "d" else 1) << 1 | block - 2 << 3, 6)
            put_pixels(out, 0xFF000000 | data << 8 if kind == "d" else data, -(-now >> block), False)
    out.put(0, 1)
    put_pixels(out, pixels, now, True)
    return out


def files(lists: list[BitList]) -> list[bytes]:
    """The files of pictures' bits."""
    out = []
    for x in packed(lists):
        body = b"\x2f" + x
        even = body + b"\0" * (len(body) & 1)
        out.append(b"RIFF" + (12 + len(even)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + even)
    return out


def encode(pixels: np.ndarray, width: int) -> bytes:
    """ARGB values as one lossless picture, by those transforms that make it shortest."""
    green = pixels >> 8 & 255
    if (pixels == (0xFF000000 | green * 0x10101)).all():
        return _grey_files([green.astype(np.uint8).tobytes()], width)[0]
    return min(files([x for way in ("", "g", "c", "d", "gd", "dc", "gdc", "p") if (x := _written(pixels, width, False, way)) is not None]), key=len)


def _grey_files(samples: list[bytes], width: int) -> list[bytes]:
    """Grey pictures, by bounds as of ``find_copies``; red and blue are green, so nothing is left of them for cross-colour."""
    data = np.frombuffer(b"".join(samples), np.uint8)
    sizes = np.array([len(x) for x in samples])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    of_count = np.repeat(np.arange(len(samples)) << 8, sizes) + data
    counts = np.bincount(of_count, minlength=len(samples) << 8).reshape(-1, 256)
    copies = find_copies(data, None, literal_costs(counts).ravel()[of_count], bounds)
    few = np.count_nonzero(counts, 1) <= 16
    smooth = neighbours_tell(data[:, None], width, bounds, counts[:, None])
    lists, of_list = [], []
    for k, symbols in enumerate(symbols_of(data, width, copies, bounds)):
        green = data[bounds[k] : bounds[k + 1]]
        own = [started(width, len(green) // width, False)]
        own[0].put(1 | 2 << 1, 4)  # less green, no further transform
        put_pixels(own[0], green, width, True, symbols)
        own += [x for way, may in (("gd", smooth[k]), ("p", few[k])) if may and (x := _written(0xFF000000 | green.astype(np.int64) * 0x10101, width, True, way)) is not None]
        lists += own
        of_list += [k] * len(own)
    out: list[bytes] = [b""] * len(samples)
    for k, file in zip(of_list, files(lists), strict=True):
        if not out[k] or len(file) < len(out[k]):
            out[k] = file
    return out


def encode_greys(samples: list[bytes]) -> list[bytes]:
    """Each value's samples, a multiple of 192, as pictures 192 wide; small pictures are written together, each as it is alone."""
    parts = [(k, x[i : i + WIDTH * MAX_HEIGHT]) for k, x in enumerate(samples) for i in range(0, len(x), WIDTH * MAX_HEIGHT)]
    out: list[list[bytes]] = [[] for _ in samples]
    i = 0
    while i < len(parts):
        j, n = i + 1, len(parts[i][1])
        while j < len(parts) and j - i < TOGETHER and n + len(parts[j][1]) < PIXELS_TOGETHER:
            n += len(parts[j][1])
            j += 1
        for (k, _), file in zip(parts[i:j], _grey_files([x for _, x in parts[i:j]], WIDTH), strict=True):
            out[k].append(file)
        i = j
    return [b"".join(x) for x in out]


def encode_grey(samples: bytes) -> bytes:
    """Samples, a multiple of 192, as pictures 192 wide."""
    return encode_greys([samples])[0]


def pictures(stored: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(stored):
        end = at + 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        yield stored[at:end]
        at = end


def decode_grey(stored: bytes) -> bytes:
    """The samples of pictures written by ``encode_grey``."""
    return b"".join((decode(x)[2] & 255).astype(np.uint8).tobytes() for x in pictures(stored))


# -- columns ---------------------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    """The text and blanks up to a positive multiple of 192."""
    return text + b" " * (-len(text) % WIDTH if text else WIDTH)


LEVELS_SQUARED = LEVELS * LEVELS


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, as a media column's feature."""
    n = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    total = len(samples)
    mean = int(n @ LEVELS) / total
    spread = max(0.0, int(n @ LEVELS_SQUARED) / total - mean * mean) ** 0.5
    p = n[n > 0] / total
    return f"mean={mean:.3f};deviation={spread:.3f};entropy={float(-(p * np.log2(p)).sum()):.3f};levels={len(p)}"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and the stored pictures of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            yield record_batch(schema, [batch.column(0), [len(x) for x in texts], encode_greys([payload_of(x) for x in texts])])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """What the stored pictures of ``media`` read back as."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for x in batch.column(2):
                x = x.as_py()
                samples = decode_grey(x)
                for column, value in zip(rows, (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(x), hashlib.sha256(x).hexdigest(), features(samples)), strict=True):
                    column.append(value)
            yield record_batch(schema, [batch.column(0), batch.column(1), *rows])

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, kinds)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(media(table(spark, sf_dir, "documents")))
