"""Numpy views of Arrow text columns: byte buffers, words and their 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and 0x09 to 0x0D.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Maps A-Z to a-z and leaves every other byte.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_POWERS: dict[int, np.ndarray] = {}
_KEPT = 1 << 20  # entries of a table of powers that a worker keeps


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables of up to _KEPT entries are kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(n if n > _KEPT else max(1 << 16, 1 << (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= _KEPT:
            _POWERS[base] = have
    return have[:n]


def inverse_powers(n: int, base: int = _BASE) -> np.ndarray:
    return powers(n, pow(base, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column laid end to end, and the len+1 offsets between rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type).cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows that hold about `size` bytes each."""
    data, offsets = buffer(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` and the row of each; words end with their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (first[:-1] | ~before))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by differences of one running polynomial sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), base))))
    return mix((total[ends] - total[starts]) * inverse_powers(len(data) + 1, base)[starts] + (ends - starts).astype(np.uint64))


def runs(h: np.ndarray, n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """A 64-bit hash of every n consecutive values of h: len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(len(h), base))))
    return mix((total[n:] - total[:-n]) * inverse_powers(len(h), base)[: len(h) - n + 1])
