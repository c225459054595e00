"""Lossless WebP images as a column type: a decoder, an encoder for tests and storage, and payload columns.

The decoder reads RIFF files with a VP8L chunk: prefix codes (simple and normal), back-references with the plane's near
distances, the colour cache, groups of codes chosen by a coarse image, and the four transforms (predictor, cross-colour,
subtract-green, palette with bundled pixels). It gives an array of shape (height, width, 4) in the order red, green,
blue, alpha.

A payload is stored as grey images 576 samples wide: under a palette where at most 16 byte values occur, else with
subtract-green, so that the code for green carries a pixel either way; a predictor is added where the file gets shorter by
it. Passages that stand earlier in the image become back-references where these are shorter. A colour cache holds no pixel
that a grey image's code for green doesn't give as shortly, and cross-colour has nothing to take from constant channels, so
streams have neither. For such streams the decoder looks the code up at every bit position at once and then only follows the
chain of lengths; any other stream goes pixel by pixel.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barline.llm._spark import ids

# Fixed values of the format: the order of the code-length codes, and the near distances (columns left, rows up).
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH, LITERALS, LENGTHS, DISTANCES = 0x1E35A7BD, 256, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
SIDE = 576  # samples in a row of a stored payload
TALLEST = 16_383  # rows of one image; longer payloads take several images
GRAM = 8  # samples that a copy must share with what it copies
SHORTEST = 12  # samples of a copy
COPY_BITS = 40  # bits of a copy's codes, and what it must save beyond them to be worth its time
BLOCK = (1 << 20) - len(NEAR)  # samples of which one may copy another; the format's largest distance
PREDICTOR_BITS = 400  # of a predictor's table and its codes
_CHUNK = 1 << 16


@lru_cache(maxsize=16)
def _reversed(bits: int) -> np.ndarray:
    """Each number below 2**bits with its bits in the other order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


class Code:
    """A canonical prefix code as one table over its longest code's bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.bits, self.symbol, self.length = 0, np.array([used[0] if len(used) else 0]), np.zeros(1, np.uint8)
        else:
            used = used[np.argsort(lengths[used], kind="stable")]
            self.bits = int(lengths[used[-1]])
            share = 1 << (self.bits - lengths[used].astype(np.int64))
            if share.sum() != 1 << self.bits:
                raise ValueError("an incomplete or overfull prefix code")
            spread = np.repeat(used, share)[_reversed(self.bits)]
            self.symbol, self.length = spread, lengths[spread].astype(np.uint8)
        self.mask = (1 << self.bits) - 1
        self._lists: tuple[list[int], list[int]] | None = None

    def lists(self) -> tuple[list[int], list[int]]:
        if self._lists is None:
            self._lists = self.symbol.tolist(), self.length.tolist()
        return self._lists


@lru_cache(maxsize=1024)
def _simple(size: int, *symbols: int) -> Code:
    """A code of one or two symbols."""
    lengths = np.zeros(size, np.int64)
    lengths[list(symbols)] = 1
    return Code(lengths)


class Reader:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0

    def peek(self) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, code: Code) -> int:
        symbols, lengths = code.lists()
        i = self.peek() & code.mask
        self.at += lengths[i]
        return symbols[i]

    def code(self, size: int) -> Code:
        if self.read(1):
            two, wide = self.read(1), self.read(1)
            first = self.read(8 if wide else 1)
            return _simple(size, first, self.read(8) if two else first)
        lengths, own = np.zeros(size, np.int64), np.zeros(19, np.int64)
        for i in range(4 + self.read(4)):
            own[ORDER[i]] = self.read(3)
        code, left = Code(own), size
        if self.read(1):
            left = 2 + self.read(2 + 2 * self.read(3))
        i, before = 0, 8
        symbols, steps = code.lists()
        while i < size and left:
            left -= 1
            s = self.peek() & code.mask
            self.at += steps[s]
            s = symbols[s]
            if s < 16:
                if s:
                    lengths[i] = before = s
                i += 1
            else:
                value, n = (before, 3 + self.read(2)) if s == 16 else (0, 3 + self.read(3)) if s == 17 else (0, 11 + self.read(7))
                if i + n > size:
                    raise ValueError("code lengths run over")
                lengths[i : i + n] = value
                i += n
        return Code(lengths)

    def value(self, symbol: int) -> int:
        """The length or distance that a prefix symbol and its extra bits stand for."""
        if symbol < 4:
            return symbol + 1
        extra = (symbol - 2) >> 1
        return ((2 + (symbol & 1)) << extra) + self.read(extra) + 1

    def distance(self, code: Code, width: int) -> int:
        near = self.value(self.symbol(code))
        if near > len(NEAR):
            return near - len(NEAR)
        x, y = NEAR[near - 1]
        return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, distance: int, n: int) -> None:
    if distance > at or at + n > len(out):
        raise ValueError("a back-reference leaves the image")
    source = out[at - distance : at - distance + min(n, distance)]
    out[at : at + n] = np.resize(source, n) if n > distance else source


def _green_only(r: Reader, width: int, total: int, codes: list[Code]) -> np.ndarray:
    """Pixels of a stream whose other channels are constant: code lengths at every bit position, then one chain through them."""
    green, others = codes[0], [int(c.symbol[0]) for c in codes[1:4]]
    out, done = np.zeros(total, np.uint32), 0
    literal = np.where(green.symbol < LITERALS, green.length, 0).astype(np.uint8)
    data = np.frombuffer(r.data, np.uint8)
    while done < total:
        first = r.at >> 3
        part = data[first : first + _CHUNK + 3].astype(np.uint32)
        if len(part) < 3:
            raise ValueError("the image data end early")
        part = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        index = ((part[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(green.mask)).ravel()
        lengths = literal[index].tobytes() + bytes(16)
        place, end, start = r.at - first * 8, len(index), done
        mark = bytearray(len(lengths))
        copies: list[tuple[int, int, int]] = []
        while done < total and place < end:
            left = total - done
            for taken in range(left):
                step = lengths[place]
                if not step:
                    break
                mark[place] = 1
                place += step
            else:
                taken = left
            done += taken
            if done < total and place < end:
                r.at = first * 8 + place
                n = r.value(r.symbol(green) - LITERALS)
                copies.append((done, n, r.distance(codes[4], width)))
                done += n
                place = r.at - first * 8
        r.at = first * 8 + place
        if done > total:
            raise ValueError("a back-reference leaves the image")
        # Literals don't depend on copies, so they are set first; copies follow in order.
        literals = np.ones(done - start, bool)
        for at, n, _ in copies:
            literals[at - start : at - start + n] = False
        out[start:done][literals] = green.symbol[index[np.flatnonzero(np.frombuffer(mark, np.uint8))]]
        for at, n, distance in copies:
            _copy(out, at, distance, n)
    red, blue, alpha = others
    return np.uint32(alpha << 24 | red << 16 | blue) | out << 8


def _pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    """One entropy-coded image: uint32 values alpha-red-green-blue."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of more than 11 bits")
    coarse, bits = None, 0
    if main and r.read(1):
        bits = 2 + r.read(3)
        coarse_width = -(-width >> bits)
        coarse = (_pixels(r, coarse_width, -(-height >> bits), False) >> 8) & 0xFFFF
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    groups = [[r.code(n) for n in sizes] for _ in range(1 if coarse is None else int(coarse.max()) + 1)]
    total = width * height
    if coarse is None and not cache_bits and groups[0][0].bits and not any(c.bits for c in groups[0][1:4]):
        return _green_only(r, width, total, groups[0])
    out, cache, i, codes = np.zeros(total, np.uint32), [0] * (1 << cache_bits), 0, groups[0]
    while i < total:
        if coarse is not None:
            codes = groups[coarse[(i // width >> bits) * coarse_width + (i % width >> bits)]]
        s = r.symbol(codes[0])
        n = 1
        if s < LITERALS:
            red, blue, alpha = r.symbol(codes[1]), r.symbol(codes[2]), r.symbol(codes[3])
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
        elif s < LITERALS + LENGTHS:
            n = r.value(s - LITERALS)
            _copy(out, i, r.distance(codes[4], width), n)
        else:
            out[i] = cache[s - LITERALS - LENGTHS]
        if cache_bits:
            for pixel in out[i : i + n].tolist():
                cache[(HASH * pixel & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel
        i += n
        if r.at > 8 * len(r.data):
            raise ValueError("the image data end early")
    return out


def _split(argb: np.ndarray) -> np.ndarray:
    return np.stack([(argb >> s) & 0xFF for s in (16, 8, 0, 24)], -1).astype(np.int32)


def _predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction from the pixels left, above, above right and above left; channels are in the last axis."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 6:
        return mean(left, corner)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(corner, top)
    if mode == 9:
        return mean(top, right)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        to_left, to_top = np.abs(top - corner).sum(-1, keepdims=True), np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        middle = mean(left, top)
        off = middle - corner
        return np.clip(middle + (off + (off < 0)) // 2, 0, 255)  # halves are cut towards 0
    return np.broadcast_to(np.array([0, 0, 0, 255], np.int32), np.shape(top))


def _unpredict(image: np.ndarray, modes: np.ndarray, bits: int, invert: bool = True) -> np.ndarray:
    """Adds (or with invert=False, takes away) each pixel's prediction, row by row. Runs of a mode that does not look left are done at once."""
    height, width, _ = image.shape
    source = image.astype(np.int32)
    whole = np.zeros_like(source) if invert else source  # the true pixels
    out = whole if invert else np.zeros_like(source)
    sign = 1 if invert else -1
    black = np.array([0, 0, 0, 255], np.int32)
    for y in range(height):
        if y == 0:
            if invert:
                whole[0] = np.cumsum(np.concatenate((source[0, :1] + black, source[0, 1:])), 0) & 255
            else:
                out[0] = np.concatenate((source[0, :1] - black, source[0, 1:] - source[0, :-1])) & 255
            continue
        out[y, 0] = (source[y, 0] + sign * whole[y - 1, 0]) & 255
        above = whole[y - 1]
        for x0 in range(0, width, 1 << bits):
            mode = int(modes[y >> bits, x0 >> bits])
            lo, hi = max(1, x0), min(width, x0 + (1 << bits))
            if lo >= hi:
                continue
            right = lambda a, b: np.concatenate((above[a + 1 : b + 1], whole[y, :1])) if b == width else above[a + 1 : b + 1]  # noqa: E731, B023
            if not invert or mode in (0, 2, 3, 4, 8, 9) or mode > 13:
                out[y, lo:hi] = (source[y, lo:hi] + sign * _predict(mode, whole[y, lo - 1 : hi - 1], above[lo:hi], right(lo, hi), above[lo - 1 : hi - 1])) & 255
            elif mode == 1:
                whole[y, lo:hi] = (whole[y, lo - 1] + np.cumsum(source[y, lo:hi], 0)) & 255
            else:
                beside = right(lo, hi)
                for x in range(lo, hi):
                    whole[y, x] = (source[y, x] + _predict(mode, whole[y, x - 1], above[x], beside[x - lo], above[x - 1])) & 255
    return out


def _cross(image: np.ndarray, table: np.ndarray, bits: int, invert: bool = True) -> np.ndarray:
    height, width, _ = image.shape
    t = np.repeat(np.repeat(table.astype(np.uint8).view(np.int8).astype(np.int32), 1 << bits, 0), 1 << bits, 1)[:height, :width]
    signed = lambda c: ((c & 255) ^ 128) - 128
    red_to_blue, green_to_blue, green_to_red = t[..., 0], t[..., 1], t[..., 2]
    out, green = image.astype(np.int32).copy(), signed(image[..., 1])
    sign = 1 if invert else -1
    red = (out[..., 0] + sign * ((green_to_red * green) >> 5)) & 255
    true_red = red if invert else out[..., 0]
    out[..., 2] = (out[..., 2] + sign * (((green_to_blue * green) >> 5) + ((red_to_blue * signed(true_red)) >> 5))) & 255
    out[..., 0] = red
    return out


def _bundle(colours: int) -> int:
    """log2 of the indices in one pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(file: bytes) -> np.ndarray:
    """Pixels (height, width, 4) of a lossless WebP file; ValueError if it is not one."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while file[at : at + 4] != b"VP8L":
        if at + 8 > len(file):
            raise ValueError("no lossless image")
        size = struct.unpack_from("<I", file, at + 4)[0]
        at += 8 + size + (size & 1)
    r = Reader(file[at + 8 : at + 8 + struct.unpack_from("<I", file, at + 4)[0]])
    if r.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height, alpha, version = r.read(14) + 1, r.read(14) + 1, r.read(1), r.read(3)
    if version:
        raise ValueError("an unknown version")
    inverse, full = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = 2 + r.read(3)
            w, h = -(-width >> bits), -(-height >> bits)
            inverse.append((kind, bits, _split(_pixels(r, w, h, False)).reshape(h, w, 4), width))
        elif kind == SUBTRACT_GREEN:
            inverse.append((kind, 0, None, width))
        else:
            n = 1 + r.read(8)
            palette = np.cumsum(_split(_pixels(r, n, 1, False)), 0) & 255
            inverse.append((kind, _bundle(n), palette, width))
            width = -(-width >> _bundle(n))
    image = _split(_pixels(r, width, height, True)).reshape(height, width, 4)
    for kind, bits, table, width in reversed(inverse):
        if kind == PREDICTOR:
            image = _unpredict(image, table[..., 1], bits)
        elif kind == CROSS_COLOUR:
            image = _cross(image, table, bits)
        elif kind == SUBTRACT_GREEN:
            for c in (0, 2):
                image[..., c] = (image[..., c] + image[..., 1]) & 255
        else:
            step = 8 >> bits
            index = image[..., 1]
            if bits:
                index = ((index[..., None] >> (np.arange(1 << bits) * step)) & ((1 << step) - 1)).reshape(height, -1)[:, :width]
            image = np.concatenate((table, np.zeros((max(0, 256 - len(table)), 4), table.dtype)))[index]
    if not alpha:
        image[..., 3] = 255
    return image[:, :full].astype(np.uint8)


class Writer:
    """Bits, lowest first."""

    def __init__(self):
        self.parts: list[str | np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(f"{value:0{n}b}"[::-1])

    def code(self, lengths: np.ndarray) -> np.ndarray:
        """Writes a code's lengths; returns those that the symbols then take (0 for a lone symbol)."""
        used = np.flatnonzero(lengths).tolist()
        if len(used) <= 2 and (not used or used[-1] < 256):
            self.put(1 | (len(used) == 2) << 1 | 4, 3)
            for symbol in used or [0]:
                self.put(symbol, 8)
            return (lengths > 0).astype(np.int64) * (len(used) == 2)
        runs, extra, all_lengths = [], [], lengths.tolist()
        for i, symbol in enumerate([*used, len(all_lengths)]):
            gap = symbol - (used[i - 1] + 1 if i else 0)
            while gap:
                n = min(gap, 138)
                runs.append(0 if n < 3 else 17 if n < 11 else 18)
                extra.append((0, 0) if n < 3 else (n - 3, 3) if n < 11 else (n - 11, 7))
                gap -= n if n >= 3 else 1
            if symbol < len(all_lengths):
                runs.append(all_lengths[symbol])
                extra.append((0, 0))
        own = lengths_of(np.bincount(runs, minlength=19), 7)
        if np.count_nonzero(own) == 1:
            own[0 if not own[0] else 1] = 1
        self.put(0, 1)
        self.put(15, 4)
        for s in ORDER:
            self.put(int(own[s]), 3)
        self.put(0, 1)
        names = spelled(own)
        for s, (value, n) in zip(runs, extra, strict=True):
            self.parts.append(names[s])
            self.put(value, n)
        return lengths if len(used) > 1 else lengths * 0

    def number(self, value: int) -> tuple[int, int, int]:
        """(prefix symbol, extra bits' value, their number) of a length or distance."""
        if value <= 4:
            return value - 1, 0, 0
        extra = (value - 1).bit_length() - 2
        high = (value - 1) >> extra
        return 2 * (extra + 1) + (high & 1), (value - 1) & ((1 << extra) - 1), extra

    def bytes(self) -> bytes:
        bits = [np.frombuffer(x.encode(), np.uint8) - 48 if isinstance(x, str) else x for x in ("".join(g) if k else next(iter(g)) for k, g in self._joined())]
        return np.packbits(np.concatenate(bits), bitorder="little").tobytes()

    def _joined(self) -> Iterator[tuple[bool, list]]:
        """Neighbouring strings together, arrays alone."""
        for is_text, group in groupby(self.parts, lambda x: isinstance(x, str)):
            if is_text:
                yield True, list(group)
            else:
                for x in group:
                    yield False, [x]


def lengths_of(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Code lengths of a Huffman code, flattened until none is over the limit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        out[used] = 1
    weights = counts[used].tolist()
    while len(used) > 1:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        for node in range(len(used), 2 * len(used) - 1):
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = node
            heapq.heapreplace(heap, (a[0] + b[0], node))
        depth = [0] * len(parent)
        for i in range(len(parent) - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= limit:
            out[used] = depth[: len(used)]
            break
        weights = [w // 2 + 1 for w in weights]
    return out


def codes_of(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Each symbol's code with its first bit lowest, and the longest code's length."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), np.int64)
    if len(used) < 2:
        return out, 0
    used = used[np.argsort(lengths[used], kind="stable")]
    bits = int(lengths[used[-1]])
    share = 1 << (bits - lengths[used])
    out[used] = _reversed(bits)[np.cumsum(share) - share]
    return out, bits


def spelled(lengths: np.ndarray) -> list[str]:
    """Each symbol's code as a string of bits, empty for symbols without one."""
    code, _ = codes_of(lengths)
    return [f"{c:0{n}b}"[::-1] if n else "" for c, n in zip(code.tolist(), lengths.tolist(), strict=True)]


def _runs(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of a pixel as copies (place, length, distance 1)."""
    edges = np.concatenate(([0], np.flatnonzero(argb[1:] != argb[:-1]) + 1, [len(argb)]))
    long = np.flatnonzero(np.diff(edges) > 8)
    return [(int(a) + 1, int(b - a) - 1, 1) for a, b in zip(edges[long], edges[long + 1], strict=True)]


def _price(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol at its share; those that don't occur have none."""
    return np.where(counts, np.log2(np.maximum(1, counts.sum()) / np.maximum(1, counts)), 0.0)


def _entropy(counts: np.ndarray) -> float:
    """Bits of all symbols at their shares."""
    used = counts[counts > 0]
    return float(used @ (np.log2(used.sum()) - np.log2(used)))


def copies_of(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """Copies (place, length, distance) of what stands earlier in the samples, where they are shorter than the samples' own codes.

    Each place's last earlier place with the same GRAM samples is found by sorting; neighbouring places at one distance make a copy. Taken
    from left to right, each copy loses what one before it has covered. Distances stay in a block of BLOCK samples, which bounds memory and
    is what the format can name.
    """
    saved = np.concatenate(([0.0], np.cumsum(_price(np.bincount(samples, minlength=256))[samples])))
    found, last = [], 0
    for base in range(0, len(samples), BLOCK):
        block = np.ascontiguousarray(samples[base : base + BLOCK])
        if len(block) <= GRAM:
            continue
        grams = np.ndarray((len(block) - GRAM + 1,), "<u8", block, 0, (1,)).copy()
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        again = np.flatnonzero(grams[1:] == grams[:-1])
        distance = np.zeros(len(order) + 1, np.int64)
        distance[order[again + 1]] = order[again + 1] - order[again]
        edges = np.concatenate(([0], np.flatnonzero(distance[1:] != distance[:-1]) + 1))
        lengths = np.diff(edges, append=len(distance)) + GRAM - 1
        kept = np.flatnonzero((distance[edges] > 0) & (lengths >= SHORTEST))
        starts, lengths, far = edges[kept], lengths[kept], distance[edges[kept]]
        for at, end, d in zip((starts + base).tolist(), (starts + lengths + base).tolist(), far.tolist(), strict=True):
            at = max(at, last)
            if end - at >= SHORTEST and saved[end] - saved[at] > COPY_BITS + d.bit_length() + (end - at).bit_length():
                found.append((at, end - at, d))
                last = end
    return found


@lru_cache(maxsize=64)
def _near(width: int) -> dict[int, int]:
    """Distances that have a near code in images of a width, each with its lowest."""
    out: dict[int, int] = {}
    for i, (x, y) in enumerate(NEAR, 1):
        out.setdefault(max(1, x + y * width), i)
    return out


def _put_image(w: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: list[tuple[int, int, int]] | None = None) -> None:
    """One entropy-coded image with the given copies, or with runs of a pixel as such. With a cache, pixels found there become cache symbols."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    n = len(argb)
    copies = [(at + i, min(length - i, 4096), d) for at, length, d in (_runs(argb) if copies is None else copies) for i in range(0, length, 4096)]
    symbols = ((argb >> 8) & 255).astype(np.int64)
    cached = np.zeros(n, bool)
    taken = np.zeros(n, bool)
    for at, length, _ in copies:
        taken[at : at + length] = True
    if cache_bits:
        cache = [0] * (1 << cache_bits)
        for i, pixel in enumerate(argb.tolist()):
            key = (HASH * pixel & 0xFFFFFFFF) >> (32 - cache_bits)
            if not taken[i] and cache[key] == pixel:
                cached[i], symbols[i] = True, LITERALS + LENGTHS + key
            cache[key] = pixel
    plain = ~taken & ~cached
    near = _near(width)
    numbers = np.array([w.number(length) for _, length, _ in copies], np.int64).reshape(-1, 3).T
    distances = np.array([w.number(near.get(d) or d + len(NEAR)) for _, _, d in copies], np.int64).reshape(-1, 3).T
    counts = np.bincount(np.concatenate((symbols[~taken], LITERALS + numbers[0])), minlength=LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0))
    lengths = [w.code(lengths_of(counts, 12))]
    rest = argb & np.uint32(0xFFFF00FF)
    if (rest == rest[0]).all():
        channels = []
        for shift in (16, 0, 24):
            w.put(5 | (int(rest[0]) >> shift & 255) << 3, 11)  # a simple code of one symbol
    else:
        channels = [((argb >> shift) & 255).astype(np.int64) for shift in (16, 0, 24)]
        lengths += [w.code(lengths_of(np.bincount(c[plain], minlength=256))) for c in channels]
    far = w.code(lengths_of(np.bincount(distances[0], minlength=DISTANCES)))
    # A token is a sample or a copy: its bits as one number, lowest first, of 59 bits at most.
    heads = np.zeros(n, bool)
    heads[[at for at, _, _ in copies]] = True
    symbols[heads] = LITERALS + numbers[0]
    tokens = np.flatnonzero(~taken | heads)
    code = codes_of(lengths[0])[0]
    bits, sizes = code[symbols[tokens]], lengths[0][symbols[tokens]]
    if copies:
        more, length = bits[heads[tokens]], sizes[heads[tokens]]
        for value, size in ((numbers[1], numbers[2]), (codes_of(far)[0][distances[0]], far[distances[0]]), (distances[1], distances[2])):
            more, length = more | value << length, length + size
        bits[heads[tokens]], sizes[heads[tokens]] = more, length
    if channels:
        for own, c in zip(lengths[1:], channels, strict=True):
            literal = plain[tokens]
            value = c[tokens]
            bits, sizes = np.where(literal, bits | codes_of(own)[0][value] << sizes, bits), np.where(literal, sizes + own[value], sizes)
    ends = np.cumsum(sizes)
    step = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes)
    w.parts.append(((np.repeat(bits, sizes) >> step) & 1).astype(np.uint8))


def _join(image: np.ndarray) -> np.ndarray:
    r, g, b, a = (image[..., i].astype(np.uint32).ravel() for i in range(4))
    return a << 24 | r << 16 | g << 8 | b


def encode(image: np.ndarray, transforms: tuple = (), cache_bits: int = 0) -> bytes:
    """A lossless WebP file of (height, width, 4) pixels.

    transforms lists, in the order of the file, (PREDICTOR, bits, modes), (CROSS_COLOUR, bits, table), (SUBTRACT_GREEN,) and
    (PALETTE,); a palette needs at most 256 colours.
    """
    height, width, _ = image.shape
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(image[..., 3].min(initial=255) < 255), 1)
    w.put(0, 3)
    image = image.astype(np.int32)
    for kind, *rest in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits, table = rest
            w.put(bits - 2, 3)
            if kind == PREDICTOR:
                image = _unpredict(image, table, bits, invert=False)
                table = np.stack([np.zeros_like(table), table, np.zeros_like(table), np.full_like(table, 255)], -1)
            else:
                image = _cross(image, table, bits, invert=False)
            _put_image(w, _join(table), table.shape[1], False)
        elif kind == SUBTRACT_GREEN:
            image = image.copy()
            image[..., [0, 2]] = (image[..., [0, 2]] - image[..., 1:2]) & 255
        else:
            colours, index = np.unique(_join(image), return_inverse=True)
            image = _put_palette(w, _split(colours), index.reshape(height, -1))
    w.put(0, 1)
    _put_image(w, _join(image), image.shape[1], True, cache_bits)
    return _file(w.bytes())


def _put_palette(w: Writer, colours: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Writes the palette; returns the image of (bundled) indices."""
    w.put(len(colours) - 1, 8)
    _put_image(w, _join(np.diff(colours, axis=0, prepend=0) & 255), len(colours), False)
    bits = _bundle(len(colours))
    if bits:
        index = np.pad(index, ((0, 0), (0, -index.shape[1] % (1 << bits)))).reshape(len(index), -1, 1 << bits)
        index = (index << (np.arange(1 << bits) * (8 >> bits))).sum(-1)
    zero = np.zeros_like(index)
    return np.stack([zero, index, zero, zero + 255], -1)


def _file(stream: bytes) -> bytes:
    pad = bytes(len(stream) & 1)
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + pad
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _residual(samples: np.ndarray, mode: int) -> np.ndarray:
    """What is left of grey samples by the predictor with the sample to the left (1) or above (2)."""
    out = samples.copy()
    out[0, 1:] -= samples[0, :-1]
    out[1:, 0] -= samples[:-1, 0]
    out[1:, 1:] -= samples[1:, :-1] if mode == 1 else samples[:-1, 1:]
    return out


def encode_grey(samples: np.ndarray) -> bytes:
    """A lossless WebP file of (height, width) grey samples.

    Under a palette where that bundles pixels, else with green taken from red and blue and, where its codes are shorter by more than its
    table, a predictor: the sample to the left or above. Copies of earlier samples are taken where they are shorter than their codes.
    """
    height, width = samples.shape
    seen = np.bincount(samples.ravel(), minlength=256) > 0
    values = np.flatnonzero(seen)
    w = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 4), (1, 1)):
        w.put(value, n)
    if _bundle(len(values)):
        w.put(PALETTE, 2)
        image = _put_palette(w, np.stack([values, values, values, np.full_like(values, 255)], -1), (np.cumsum(seen) - 1)[samples])
        argb, width = _join(image), image.shape[1]
    else:
        w.put(SUBTRACT_GREEN, 2)
        ways = {0: samples, 1: _residual(samples, 1), 2: _residual(samples, 2)}
        bits = {}
        for mode, left in ways.items():
            bits[mode] = _entropy(np.bincount(left.ravel(), minlength=256)) + (PREDICTOR_BITS if mode else 0)
        mode = min(bits, key=bits.__getitem__)
        if mode:
            w.put(1, 1)
            w.put(PREDICTOR, 2)
            w.put(7, 3)  # blocks of 512 samples
            _put_image(w, np.full((-(-height // 512)) * -(-width // 512), 0xFF000000 | mode << 8, np.uint32), -(-width // 512), False)
        argb = np.uint32(0 if mode else 0xFF000000) | ways[mode].ravel().astype(np.uint32) << 8
    w.put(0, 1)
    _put_image(w, argb, width, True, 0, copies_of(((argb >> 8) & 255).astype(np.uint8)))
    return _file(w.bytes())


def store(payload: bytes) -> list[bytes]:
    """The images of a payload whose size is a multiple of SIDE."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    return [encode_grey(samples[i : i + TALLEST]) for i in range(0, len(samples), TALLEST)]


def load(images: list[bytes]) -> np.ndarray:
    """The grey samples of stored images, as one (rows, SIDE) array."""
    return np.concatenate([decode(x)[..., 1] for x in images])


def feature(samples: np.ndarray) -> str:
    """Of the samples: mean and standard deviation, to 3 places, and a 64-bit average hash of an 8 x 8 grid in hex."""
    total, squares = int(samples.sum(dtype=np.int64)), int(np.square(samples, dtype=np.int64).sum())
    mean = total / samples.size
    rows = np.linspace(0, len(samples), 9).astype(np.int64)
    grid = np.add.reduceat(samples.reshape(len(samples), 8, -1).sum(-1, dtype=np.int64), np.minimum(rows[:-1], len(samples) - 1)) / np.maximum(1, np.diff(rows))[:, None]
    mark = np.packbits(grid > grid.mean()).tobytes().hex()
    return f"{mean:.3f} {max(0.0, squares / samples.size - mean * mean) ** 0.5:.3f} {mark}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stores each text as images, reads the images back, and describes what was read."""
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            raw = (text.as_py() or "").encode()
            images = store(raw + b"\xff" * (-len(raw) % SIDE or SIDE * (not raw)))
            media, samples = b"".join(images), load(images)
            payload = np.ascontiguousarray(samples).tobytes()
            rows.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if name.endswith("string") else pa.int64()) for x, name in zip(columns, SCHEMA.split(", "), strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def text_media(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document about its text stored as lossless WebP: see SCHEMA.

    The payload is the UTF-8 text with bytes 255 up to a positive multiple of 576. Null and empty texts are 576 pad bytes;
    texts over 9.4 million bytes take several images, whose bytes stand one after another. Equal texts give equal values. Repeated
    rows are stored each; rows with a null id leave. An empty table gives no rows; further columns are not read.
    """
    return ids(documents, id_column, text_column).mapInArrow(digest, SCHEMA)


def decode_column(files: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, width, height and pixels (bytes red-green-blue-alpha, row by row) of a column of lossless WebP files.

    Null and broken files have null in all three; rows with a null id stay. An empty table gives no rows.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file in batch["file"].to_pylist():
                try:
                    image = decode(file) if file is not None else None
                except (ValueError, IndexError, struct.error):
                    image = None
                found.append((None, None, None) if image is None else (image.shape[1], image.shape[0], image.tobytes()))
            width, height, pixels = list(zip(*found, strict=True)) or ([], [], [])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(pixels, pa.binary())], names=["id", "width", "height", "pixels"])

    rows = files.select(F.col(id_column).alias("id"), F.col(column).cast("binary").alias("file"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, width int, height int, pixels binary")
