"""Lossless WebP: a reader of the whole bit stream and a writer.

The reader decodes many streams side by side: each step decodes one pixel of every
stream with numpy, so the work per pixel does not run in Python.  A stream may use
prefix codes with several groups, back-references, a colour cache, and the predictor,
cross-colour, subtract-green and palette transforms.  Pixels are 32-bit ARGB.
"""

from __future__ import annotations

import functools
import math
import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
N_LENGTHS, N_DISTANCES = 24, 40
CACHE_FACTOR = 0x1E35A7BD
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Near pixels, by distance, lower rows first, right before left: 120 of them.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0),
              key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], p[0] < 0))
#: Longest code that the writer makes; four of them fit in a 64-bit window.
MOST_BITS = 12
#: Payload bytes of a frame; longer payloads become animations, whose frames decode side by side.
FRAME_BYTES = 32 * 1024
ROW_PIXELS = 16
#: Colour cache of a frame, and about the bits that a symbol takes in a code.
CACHE_BITS, CODE_BITS = 6, 6
#: Table entries of the streams that are decoded side by side.
TABLE_ENTRIES = 1 << 23

_REVERSED = {n: np.array([int(f"{i:0{n}b}"[::-1], 2) if n else 0 for i in range(1 << n)]) for n in range(16)}


def near_distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# --- prefix codes -----------------------------------------------------------


def code_table(lengths: np.ndarray) -> np.ndarray:
    """Look-up by the next bits of a stream: ``symbol << 4 | bits`` for canonical code lengths."""
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return (used if len(used) else np.zeros(1, np.int64)).astype(np.uint32) << 4
    used = used[np.argsort(lengths[used], kind="stable")]
    bits = lengths[used].astype(np.int64)
    most = int(bits[-1])
    table = np.repeat((used << 4 | bits).astype(np.uint32), 1 << (most - bits))
    if len(table) != 1 << most:
        raise ValueError("a prefix code is not complete")
    return table[_REVERSED[most]]


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        n = len(weights)
        # Sums never fall, so the least is the next leaf or the next sum; a leaf goes before an equal sum.
        leaves = sorted(zip(weights, range(n)))
        leaves.append((math.inf, 0))
        sums, parent = [], [0] * (2 * n - 1)
        i = j = 0
        for node in range(n, 2 * n - 1):
            weight, child = leaves[i]
            if j < node - n and sums[j] < weight:
                weight, child = sums[j], n + j
                j += 1
            else:
                i += 1
            other, second = leaves[i]
            if j < node - n and sums[j] < other:
                other, second = sums[j], n + j
                j += 1
            else:
                i += 1
            parent[child] = parent[second] = node
            sums.append(weight + other)
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= most:
            out[used] = depth[:n]
            return out
        weights = [(w + 1) // 2 for w in weights]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The bits of each symbol in stream order."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.uint64)
    if len(used) < 2:
        return out
    used = used[np.argsort(lengths[used], kind="stable")]
    bits = lengths[used]
    most = int(bits[-1])
    starts = np.append(0, np.cumsum(1 << (most - bits)))[:-1]
    out[used] = _REVERSED[most][starts]
    return out


# --- reading ----------------------------------------------------------------


class Bits:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte:byte + 8], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def span(self, at: int, n: int) -> int:
        """``n`` bits as a number, without moving on."""
        return int.from_bytes(self.data[at >> 3:(at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)


@functools.lru_cache(256)
def _length_table(n: int, packed: int) -> list[int]:
    """The table of the code of the code lengths, from its own first ``n`` lengths of three bits."""
    first = np.zeros(19, np.uint8)
    first[list(LENGTH_ORDER[:n])] = [packed >> 3 * i & 7 for i in range(n)]
    return code_table(first).tolist()


def read_code(bits: Bits, size: int) -> np.ndarray:
    """Code lengths of an alphabet; a code of one symbol takes no bits."""
    lengths = bytearray(size)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return np.frombuffer(lengths, np.uint8)
    n = 4 + bits.read(4)
    table = _length_table(n, bits.read(3 * n))
    mask = len(table) - 1
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    data, at, symbol, last = bits.data, bits.at, 0, 8
    window = held = 0
    while symbol < size and left:
        left -= 1
        if held < 14:  # the longest token
            window, held = int.from_bytes(data[at >> 3:(at >> 3) + 8], "little") >> (at & 7), 64 - (at & 7)
        entry = table[window & mask]
        used, value = entry & 15, entry >> 4
        window >>= used
        at += used
        held -= used
        if value < 16:
            lengths[symbol] = value
            symbol += 1
            last = value or last
        else:
            extra, base, fill = ((2, 3, last), (3, 3, 0), (7, 11, 0))[value - 16]
            count = base + (window & ((1 << extra) - 1))
            window >>= extra
            at += extra
            held -= extra
            if symbol + count > size:
                raise ValueError("a prefix code is too long")
            if fill:
                lengths[symbol:symbol + count] = bytes([fill]) * count
            symbol += count
    bits.at = at
    return np.frombuffer(lengths, np.uint8)


@dataclass
class Image:
    """An entropy-coded image whose codes have been read and whose pixels begin at ``bits.at``."""

    bits: Bits
    width: int
    height: int
    cache_bits: int
    tables: list[list[np.ndarray]]
    group_bits: int = 0
    groups: np.ndarray | None = None
    transforms: list = field(default_factory=list)
    final_width: int = 0
    pixels: np.ndarray | None = None


def _blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def read_image(bits: Bits, width: int, height: int, main: bool) -> Image:
    cache_bits = bits.read(4) if bits.read(1) else 0
    group_bits, groups, n = 0, None, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        map_ = read_image(bits, _blocks(width, group_bits), _blocks(height, group_bits), False)
        decode_pixels([map_])
        groups = (map_.pixels >> 8 & 0xFFFF).astype(np.int64)
        n = int(groups.max()) + 1
    sizes = (256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    tables, known = [], {}
    for _ in range(n):
        row, begin, lengths = [], 0, None
        for channel, size in enumerate(sizes):
            # The bits of a code often follow once more for the next channel.
            used = bits.at - begin
            if channel in (2, 3) and bits.span(begin, used) == bits.span(bits.at, used):
                begin, bits.at = bits.at, bits.at + used
            else:
                begin, lengths = bits.at, read_code(bits, size)
            key = lengths.tobytes()
            if key not in known:
                known[key] = code_table(lengths)
            row.append(known[key])
        tables.append(row)
    return Image(bits, width, height, cache_bits, tables, group_bits, groups)


def read_stream(data: bytes) -> Image:
    """Header, transforms and codes of a VP8L stream."""
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            part = read_image(bits, _blocks(now, size), _blocks(height, size), False)
            decode_pixels([part])
            transforms.append((kind, now, size, part.pixels.reshape(part.height, part.width)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            part = read_image(bits, n, 1, False)
            decode_pixels([part])
            colours = np.cumsum(part.pixels.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8)
            packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, now, packing, colours.reshape(-1).view(np.uint32)))
            now = _blocks(now, packing)
        else:
            transforms.append((kind, now, 0, None))
    image = read_image(bits, now, height, True)
    image.transforms, image.final_width = transforms, width
    return image


def _value(bits: Bits, symbol: int) -> int:
    """The length or distance code of a prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def decode_pixels(images: list[Image]) -> None:
    """Fill ``pixels`` of each image; one step decodes the next pixel of all of them."""
    images = sorted(images, key=lambda i: -i.width * i.height)
    counts = np.array([i.width * i.height for i in images])
    padded = [i.bits.data + b"\0" * (16 + -len(i.bits.data) % 8) for i in images]
    words = np.frombuffer(b"".join(padded), "<u8")
    base = np.append(0, np.cumsum([len(p) for p in padded]))[:-1] * 8
    at = base + np.array([i.bits.at for i in images])
    flat, offsets, masks, size, known = [], [], [], 0, {}
    first_group = []
    for image in images:
        first_group.append(len(offsets))
        for row in image.tables:
            places = []
            for table in row:
                if id(table) not in known:
                    known[id(table)] = size
                    flat.append(table)
                    size += len(table)
                places.append(known[id(table)])
            offsets.append(places)
            masks.append([len(t) - 1 for t in row])
    flat = np.concatenate(flat)
    offsets, masks, first_group = np.array(offsets), np.array(masks, np.uint64), np.array(first_group)
    out_base = np.append(0, np.cumsum(counts))
    out = np.zeros(int(out_base[-1]), np.uint32)
    out_base = out_base[:-1]
    grouped = [i for i, image in enumerate(images) if image.groups is not None]
    cached = np.array([i for i, image in enumerate(images) if image.cache_bits], np.int64)
    cache_bits = np.array([images[i].cache_bits for i in cached], np.int64)
    cache_base = np.append(0, np.cumsum(1 << cache_bits))
    cache = np.zeros(int(cache_base[-1]), np.uint32)
    slot = np.zeros(len(images), np.int64)
    slot[cached] = cache_base[:-1]
    cache_shift = (32 - cache_bits).astype(np.uint32)
    copies = np.zeros(len(images), np.int64)
    distance = np.zeros(len(images), np.int64)
    group = first_group.copy()
    goff, gmask = offsets[group].T.copy(), masks[group].T.copy()
    live, copying = len(images), False
    one = np.uint64(1)
    for step in range(int(counts[0]) if len(counts) else 0):
        while counts[live - 1] <= step:
            live -= 1
        for i in grouped:
            if i < live:
                image = images[i]
                y, x = divmod(step, image.width)
                group[i] = first_group[i] + image.groups[
                    (y >> image.group_bits) * _blocks(image.width, image.group_bits) + (x >> image.group_bits)]
                goff[:, i], gmask[:, i] = offsets[group[i]], masks[group[i]]
        place = at[:live]
        word, shift = place >> 6, (place & 63).view(np.uint64)
        window = words[word] >> shift | words[word + 1] << (np.uint64(63) - shift) << one
        entry = flat[goff[0, :live] + (window & gmask[0, :live]).view(np.int64)]
        green, used = entry >> 4, entry & 15
        first = used
        spent = used.copy()
        pixel = green << 8
        for channel, to in ((1, 16), (2, 0), (3, 24)):
            window = window >> used
            entry = flat[goff[channel, :live] + (window & gmask[channel, :live]).view(np.int64)]
            used = entry & 15
            pixel = pixel | (entry >> 4) << to
            spent += used
        if copying:
            busy = np.flatnonzero(copies[:live])
            spent[busy] = 0
            green[busy] = 0
        special = np.flatnonzero(green > 255) if int(green.max()) > 255 else ()
        if len(special) and len(cached):
            symbol = green[special]
            named = special[symbol >= 256 + N_LENGTHS]
            pixel[named] = cache[slot[named] + green[named] - (256 + N_LENGTHS)]
            spent[named] = first[named]
            special = special[symbol < 256 + N_LENGTHS]
        for i in special:
            i = int(i)
            image, symbol = images[i], int(green[i])
            bits = Bits(image.bits.data, int(at[i] - base[i]) + int(first[i]))
            length = _value(bits, symbol - 256)
            entry_d = int(flat[goff[4, i] + (int(_window(words, base[i] + bits.at)) & int(gmask[4, i]))])
            bits.at += entry_d & 15
            distance[i] = near_distance(_value(bits, entry_d >> 4), image.width)
            if distance[i] > step:
                raise ValueError("a back-reference leaves the image")
            copies[i] = min(length, int(counts[i]) - step)
            spent[i] = bits.at - int(at[i] - base[i])
            copying = True
        at[:live] = place + spent
        if copying:
            busy = np.flatnonzero(copies[:live])
            pixel[busy] = out[out_base[busy] + step - distance[busy]]
            copies[busy] -= 1
            copying = bool(copies.any())
        out[out_base[:live] + step] = pixel
        if len(cached):
            k = int(np.searchsorted(cached, live))
            value = pixel[cached[:k]].astype(np.uint32)
            cache[cache_base[:k] + (value * np.uint32(CACHE_FACTOR) >> cache_shift[:k])] = value
    for i, image in enumerate(images):
        image.pixels = out[out_base[i]:out_base[i] + counts[i]]
        image.bits.at = int(at[i] - base[i])


def _window(words: np.ndarray, at: int) -> int:
    word, shift = int(at) >> 6, int(at) & 63
    return (int(words[word]) >> shift | int(words[word + 1]) << (64 - shift)) & 0xFFFFFFFFFFFFFFFF


# --- transforms -------------------------------------------------------------


def _average(a, b):
    return (a + b) >> 1


def predict(mode: int, left, top, corner, right):
    """The prediction of a mode from neighbours as ``(…, 4)`` arrays of 16 bits or more."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        by_left = np.abs(top - corner).sum(axis=-1, keepdims=True)
        by_top = np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(by_left < by_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        middle = _average(left, top)
        # The half of a difference rounds toward zero.
        half = (np.abs(middle - corner) >> 1) * np.sign(middle - corner)
        return np.clip(middle + half, 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255]), np.shape(left))


def undo_predictor(pixels: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    height, width = pixels.shape
    rest = pixels.view(np.uint8).reshape(height, width, 4).astype(np.int64)
    out = np.zeros((height, width + 1, 4), np.int64)
    rest[0, 0, 3] += 255
    out[0, :width] = np.cumsum(rest[0], axis=0) & 255
    for y in range(1, height):
        out[y - 1, width] = out[y, 0] = (out[y - 1, 0] + rest[y, 0]) & 255
        for block in range(modes.shape[1]):
            a, b = max(1, block << bits), min(width, (block + 1) << bits)
            mode = int(modes[y >> bits, block] >> 8 & 15)
            if a >= b:
                continue
            up = out[y - 1]
            if mode == 1:
                out[y, a:b] = (out[y, a - 1] + np.cumsum(rest[y, a:b], axis=0)) & 255
            elif mode in (5, 6, 7, 10, 11, 12, 13):
                for x in range(a, b):
                    guess = predict(mode, out[y, x - 1], up[x], up[x - 1], up[x + 1])
                    out[y, x] = (rest[y, x] + guess) & 255
            else:
                guess = predict(mode, up[a:b], up[a:b], up[a - 1:b - 1], up[a + 1:b + 1])
                out[y, a:b] = (rest[y, a:b] + guess) & 255
    return out[:, :width].astype(np.uint8).reshape(height, -1).view(np.uint32)


def _signed(x):
    return x.astype(np.int8).astype(np.int64)


def _cross(pixels: np.ndarray, bits: int, elements: np.ndarray, sign: int) -> np.ndarray:
    height, width = pixels.shape
    blue, green, red, alpha = np.moveaxis(pixels.view(np.uint8).reshape(height, width, 4), -1, 0)
    spread = np.repeat(np.repeat(elements, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]
    by_red, by_green, of_red = (_signed((spread >> s & 255).astype(np.uint8)) for s in (16, 8, 0))
    g = _signed(green)
    shift_red = of_red * g >> 5
    other = (red + sign * shift_red).astype(np.uint8)
    source = _signed(other if sign > 0 else red)  # the original red in either direction
    shift_blue = (by_green * g >> 5) + (by_red * source >> 5)
    blue = (blue + sign * shift_blue).astype(np.uint8)
    return np.stack([blue, green, other, alpha], axis=-1).reshape(height, -1).view(np.uint32)


def undo_transforms(image: Image) -> np.ndarray:
    pixels = image.pixels.reshape(image.height, image.width)
    for kind, width, bits, data in reversed(image.transforms):
        if kind == PREDICTOR:
            pixels = undo_predictor(np.ascontiguousarray(pixels), bits, data)
        elif kind == CROSS_COLOUR:
            pixels = _cross(np.ascontiguousarray(pixels), bits, data, 1)
        elif kind == SUBTRACT_GREEN:
            parts = np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4).copy()
            parts[..., 0] += parts[..., 1]
            parts[..., 2] += parts[..., 1]
            pixels = parts.reshape(pixels.shape[0], -1).view(np.uint32)
        else:
            index = pixels >> 8 & 255
            if bits:
                each, many = 8 >> bits, 1 << bits
                index = (index[..., None] >> (np.arange(many, dtype=np.uint32) * each) & ((1 << each) - 1))
                index = index.reshape(image.height, -1)[:, :width]
            table = np.append(data, np.zeros(256, np.uint32))
            pixels = table[index]
    return pixels


# --- writing ----------------------------------------------------------------


class Writer:
    def __init__(self):
        self.values, self.sizes = [], []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def code(self, lengths: np.ndarray) -> None:
        """The code lengths of an alphabet: a simple code, or lengths with runs of zeros."""
        used = np.flatnonzero(lengths).tolist()
        if len(used) <= 2 and (not used or used[-1] < 256):
            used = used or [0]
            self.put(1 | (len(used) - 1) << 1 | 1 << 2 | used[0] << 3, 11)
            if len(used) == 2:
                self.put(used[1], 8)
            return
        self.put(*_LENGTHS_HEAD)
        lengths_used = lengths[used].tolist()
        tokens, n, last = [], 0, -1
        for symbol, length in zip(used, lengths_used):
            value, size, count = _gap(symbol - last - 1)
            tokens.append((value | _LENGTH_CODE[length] << size, size + 4))
            n += count + 1
            last = symbol
        self.put(1 | 4 << 1 | (n - 2) << 4, 14)
        values, sizes = zip(*tokens)
        self.values += values
        self.sizes += sizes

    def bytes(self, *more: tuple[np.ndarray, np.ndarray]) -> bytes:
        values = np.concatenate([np.array(self.values, np.uint64), *(v for v, _ in more)])
        sizes = np.concatenate([np.array(self.sizes, np.int64), *(s for _, s in more)])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, shift = starts >> 6, (starts & 63).astype(np.uint64)
        low = values << shift
        high = values >> (np.uint64(63) - shift) >> np.uint64(1)
        words = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        cuts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[cuts]] |= np.bitwise_or.reduceat(low, cuts)
        words[word[cuts] + 1] |= np.bitwise_or.reduceat(high, cuts)
        return words.astype("<u8").tobytes()[:(int(ends[-1]) + 7) >> 3]


_LENGTH_CODE = {s: int(_REVERSED[4][i]) for i, s in enumerate((*range(14), 17, 18))}
#: That a code is not simple, and the length of each symbol in the code of its lengths.
_LENGTHS_HEAD = (15 << 1 | sum((4 if s in _LENGTH_CODE else 0) << 5 + 3 * i for i, s in enumerate(LENGTH_ORDER)), 5 + 3 * len(LENGTH_ORDER))


@functools.cache
def _gap(gap: int) -> tuple[int, int, int]:
    """Bits, their number and the number of tokens of so many symbols that are not used."""
    value = size = count = 0
    while gap:
        if gap >= 11:
            n = min(gap, 138)
            token, bits = _LENGTH_CODE[18] | (n - 11) << 4, 11
        elif gap >= 3:
            n, token, bits = gap, _LENGTH_CODE[17] | (gap - 3) << 4, 7
        else:
            n, token, bits = 1, _LENGTH_CODE[0], 4
        value, size, count, gap = value | token << size, size + bits, count + 1, gap - n
    return value, size, count


def prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    high = value.bit_length() - 1
    second = value >> (high - 1) & 1
    extra = high - 1
    return 2 * high + second, value & ((1 << extra) - 1), extra


def _runs(pixels: np.ndarray, least: int = 4) -> list[tuple[int, int]]:
    """Where ``least`` or more pixels repeat the one before: start and length."""
    same = np.append(False, pixels[1:] == pixels[:-1])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return [(a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if b - a >= least]


def cache_places(pixels: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in the colour cache, and whether the cache holds the pixel then."""
    keys = (pixels * np.uint32(CACHE_FACTOR) >> np.uint32(32 - cache_bits)).astype(np.uint16)
    order = np.argsort(keys, kind="stable")
    ranked, again = pixels[order], np.zeros(len(pixels), bool)
    again[order[1:]] = ranked[1:] == ranked[:-1]
    return keys, again


def _write_image(writer: Writer, pixels: np.ndarray, main: bool, cache_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Put the codes of an image; the bits of its pixels are returned."""
    runs = [(a + k, min(4096, n - k)) for a, n in _runs(pixels) for k in range(0, n, 4096)]
    keep = np.ones(len(pixels), bool)
    for a, n in runs:
        keep[a:a + n] = False
    keep[[a for a, _ in runs]] = True
    place = np.flatnonzero(keep)
    parts = pixels[place].view(np.uint8).reshape(-1, 4)
    green = parts[:, 1].astype(np.int64)
    literal = np.ones(len(place), bool)
    extra, extra_bits = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
    for (_, n), i in zip(runs, np.searchsorted(place, [a for a, _ in runs]).tolist()):
        symbol, value, size = prefix_of(n)
        green[i], literal[i], extra[i], extra_bits[i] = 256 + symbol, False, value, size
    writer.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if cache_bits:
        # A pixel that the cache holds is named by its place there.
        keys, again = cache_places(pixels, cache_bits)
        named = literal & again[place]
        green[named], literal[named] = 256 + N_LENGTHS + keys[place[named]].astype(np.int64), False
    if main:
        writer.put(0, 1)
    size = 256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0)
    lengths_green = code_lengths(np.bincount(green, minlength=size))
    literal = np.flatnonzero(literal)
    others = parts[:, [2, 0, 3]] if len(literal) == len(parts) else parts[literal][:, [2, 0, 3]]
    lengths_other = code_lengths(np.bincount(others.reshape(-1), minlength=256))
    writer.code(lengths_green)
    begin = len(writer.values)
    writer.code(lengths_other)
    writer.values += writer.values[begin:] * 2
    writer.sizes += writer.sizes[begin:] * 2
    writer.code(np.array([0, int(bool(runs))] + [0] * (N_DISTANCES - 2)))
    bits_green, bits_other = (np.where(np.count_nonzero(x) > 1, x, 0).astype(np.uint64) for x in (lengths_green, lengths_other))
    codes_green, codes_other = codes_of(lengths_green), codes_of(lengths_other)
    values, sizes = codes_green[green], bits_green[green]
    values |= extra << sizes
    sizes += extra_bits
    if len(literal) < len(values):
        all_values, all_sizes = values, sizes
        values, sizes = values[literal], sizes[literal]
    for channel in range(3):
        symbol = others[:, channel]
        values |= codes_other[symbol] << sizes
        sizes += bits_other[symbol]
    if len(literal) < len(parts):
        all_values[literal], all_sizes[literal] = values, sizes
        values, sizes = all_values, all_sizes
    return values, sizes.view(np.int64)


def write_stream(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, block_bits: int = 2, mode: int = 11) -> bytes:
    """A VP8L stream of a ``(height, width)`` image with these transforms.

    The predictor uses one mode throughout, cross-colour one element, the palette the
    distinct pixels in order (at most 256).
    """
    height, width = pixels.shape
    writer = Writer()
    writer.put(SIGNATURE | width - 1 << 8 | height - 1 << 22 | 1 << 36, 40)
    chunks = []

    def part(sub):
        chunks.append(_write_image(writer, sub, False))
        values, sizes = chunks.pop()
        writer.values += values.tolist()
        writer.sizes += sizes.tolist()

    for kind in transforms:
        writer.put(1 | kind << 1, 3)
        n_blocks = _blocks(pixels.shape[1], block_bits) * _blocks(height, block_bits)
        if kind == PREDICTOR:
            writer.put(block_bits - 2, 3)
            part(np.full(n_blocks, 0xFF000000 | mode << 8, np.uint32))
            pixels = _predicted(pixels, mode)
        elif kind == CROSS_COLOUR:
            writer.put(block_bits - 2, 3)
            element = 0xFF000000 | 5 << 16 | 250 << 8 | 9
            part(np.full(n_blocks, element, np.uint32))
            grid = np.full((_blocks(height, block_bits), _blocks(pixels.shape[1], block_bits)), element, np.uint32)
            pixels = _cross(np.ascontiguousarray(pixels), block_bits, grid, -1)
        elif kind == SUBTRACT_GREEN:
            parts = np.ascontiguousarray(pixels).view(np.uint8).reshape(height, -1, 4).copy()
            parts[..., 0] -= parts[..., 1]
            parts[..., 2] -= parts[..., 1]
            pixels = parts.reshape(height, -1).view(np.uint32)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            index = index.reshape(pixels.shape).astype(np.uint32)
            writer.put(len(colours) - 1, 8)
            steps = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8))
            part(np.ascontiguousarray(steps).reshape(-1).view(np.uint32))
            packing = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            many = 1 << packing
            index = np.pad(index, ((0, 0), (0, -index.shape[1] % many))).reshape(height, -1, many)
            packed = (index << (np.arange(many, dtype=np.uint32) * (8 >> packing))).sum(axis=-1, dtype=np.uint32)
            pixels = packed << 8 | np.uint32(0xFF000000)
    writer.put(0, 1)
    data = _write_image(writer, np.ascontiguousarray(pixels).reshape(-1), True, cache_bits)
    return writer.bytes(data)


def _predicted(pixels: np.ndarray, mode: int) -> np.ndarray:
    height, width = pixels.shape
    now = np.ascontiguousarray(pixels).view(np.uint8).reshape(height, width, 4).astype(np.int64)
    out = now.copy()
    out[0, 0, 3] -= 255
    out[0, 1:] -= now[0, :-1]
    if height > 1:
        right = np.concatenate([now[:-1, 1:], now[1:, :1]], axis=1)  # past the end: the first of this row
        guess = predict(mode, np.roll(now, 1, axis=1)[1:], now[:-1], np.roll(now, 1, axis=1)[:-1], right)
        out[1:, 1:] -= guess[:, 1:]
        out[1:, 0] -= now[:-1, 0]
    return (out & 255).astype(np.uint8).reshape(height, -1).view(np.uint32)


# --- files ------------------------------------------------------------------


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_file(streams: list[bytes], sizes: list[tuple[int, int]]) -> bytes:
    """A WebP file: a still image, or an animation of several frames."""
    if len(streams) == 1:
        body = _chunk(b"VP8L", streams[0])
    else:
        wide, high = max(w for w, _ in sizes), max(h for _, h in sizes)
        three = lambda n: struct.pack("<I", n)[:3]
        body = _chunk(b"VP8X", struct.pack("<I", 0x12) + three(wide - 1) + three(high - 1))
        body += _chunk(b"ANIM", struct.pack("<IH", 0, 0))
        for stream, (w, h) in zip(streams, sizes):
            body += _chunk(b"ANMF", three(0) + three(0) + three(w - 1) + three(h - 1) + three(0) + b"\2"
                           + _chunk(b"VP8L", stream))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def read_file(data: bytes) -> list[bytes]:
    """The lossless streams of a WebP file, in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")

    def chunks(a, b):
        while a + 8 <= b:
            size = struct.unpack_from("<I", data, a + 4)[0]
            if data[a:a + 4] == b"VP8L":
                yield data[a + 8:a + 8 + size]
            elif data[a:a + 4] == b"ANMF":
                yield from chunks(a + 24, a + 8 + size)
            elif data[a:a + 4] == b"VP8 ":
                raise ValueError("a lossy image")
            a += 8 + size + (size & 1)

    return list(chunks(12, 8 + struct.unpack_from("<I", data, 4)[0]))


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """The ``(height, width)`` pixels of each stream; long ones are decoded together."""
    images = [read_stream(s) for s in streams]
    order = sorted(range(len(images)), key=lambda i: -images[i].width * images[i].height)
    batch, entries = [], 0
    for i in order:
        size = sum(len(t) for t in {id(t): t for row in images[i].tables for t in row}.values())
        if batch and entries + size > TABLE_ENTRIES:
            decode_pixels(batch)
            batch, entries = [], 0
        batch.append(images[i])
        entries += size
    if batch:
        decode_pixels(batch)
    return [undo_transforms(image) for image in images]


def _code_bits(counts: np.ndarray) -> float:
    """About the bits of symbols and of their code."""
    counts = counts[counts > 0]
    total = counts.sum()
    return float(total * np.log2(total) - (counts * np.log2(counts)).sum()) + CODE_BITS * len(counts) if total else 0.0


def _distinct(values: np.ndarray) -> int:
    values = np.sort(values)
    return int(np.count_nonzero(values[1:] != values[:-1])) + 1


def _cache_helps(pixels: np.ndarray) -> bool:
    """Whether the colour cache is expected to save more than its code takes."""
    keys, again = cache_places(pixels, CACHE_BITS)
    if np.count_nonzero(again) * 8 < len(pixels):
        return False
    parts = pixels.view(np.uint8).reshape(-1, 4)
    literal, green = parts[~again], np.bincount(parts[:, 1], minlength=256)
    left = np.bincount(literal[:, 1], minlength=256)
    all_, rest = (np.bincount(x.reshape(-1), minlength=256) for x in (parts, literal))
    plain = _code_bits(green) + _code_bits(all_ - green)
    short = _code_bits(np.append(left, np.bincount(keys[again]))) + _code_bits(rest - left)
    return short < 0.98 * plain


def _frame(pixels: np.ndarray) -> bytes:
    """The stream of a frame, in a form that its own pixels choose.

    It is written plainly and, where its colours are few, the colour cache is expected
    to save bits, pixels often repeat the one above or the one before them, or samples
    the green one, also with the palette, the cache or other transforms; the smallest
    stream is taken.
    """
    flat = pixels.reshape(-1)
    # Many different pixels at the start are enough to know that they are not few.
    colours = _distinct(flat[:1024])
    if colours <= 256 and len(flat) > 1024:
        colours = _distinct(flat)
    few = colours <= 256 and len(flat) >= 4 * colours
    best, tries = write_stream(pixels), [((PALETTE,), 0)] if few else []
    if not few and _cache_helps(flat):
        best = min(best, write_stream(pixels, (), CACHE_BITS), key=len)
    if np.count_nonzero(pixels[1:] == pixels[:-1]) * 4 > len(flat):
        tries += [((PREDICTOR,), 2), ((PREDICTOR, SUBTRACT_GREEN), 2)]
    if np.count_nonzero(flat[1:] == flat[:-1]) * 4 > len(flat):
        tries += [((PREDICTOR,), 1)]
    parts = flat.view(np.uint8).reshape(-1, 4)
    if np.count_nonzero(parts[:, 1] == parts[:, 2]) * 4 > len(flat):
        tries += [((SUBTRACT_GREEN,), 0), ((CROSS_COLOUR,), 0)]
    for transforms, mode in tries:
        best = min(best, write_stream(pixels, transforms, block_bits=9, mode=mode), key=len)
    return best


def store(payload: bytes) -> bytes:
    """A payload of whole 64-byte rows as the red, green, blue and alpha samples of an image."""
    streams, sizes = [], []
    for a in range(0, len(payload), FRAME_BYTES):
        samples = np.frombuffer(payload[a:a + FRAME_BYTES], np.uint8).reshape(-1, 4)
        pixels = np.ascontiguousarray(samples[:, [2, 1, 0, 3]]).reshape(-1).view(np.uint32).reshape(-1, ROW_PIXELS)
        streams.append(_frame(pixels))
        sizes.append((ROW_PIXELS, len(pixels)))
    return write_file(streams, sizes)


def load_many(files: list[bytes]) -> list[tuple[bytes, list[np.ndarray]]]:
    """The payload and the images of each stored file."""
    streams = [read_file(f) for f in files]
    images = iter(decode_streams([s for row in streams for s in row]))
    out = []
    for row in streams:
        mine = [next(images) for _ in row]
        data = b"".join(np.ascontiguousarray(
            np.ascontiguousarray(i).view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]]).tobytes() for i in mine)
        out.append((data, mine))
    return out
