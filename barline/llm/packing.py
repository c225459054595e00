"""Sum-of-squares online packing of tokenised documents into windows of fixed length.

Documents arrive one by one. N[h] counts the open windows that are filled to level h (0 < h < capacity). A document's
last piece of s tokens goes to the level h whose choice makes sum(N[h]**2) grow least: onto a window at h <= capacity - s,
or into a new window. Only the level array decides, so each placement costs one pass over it.

Longer documents are first cut into full windows. When a partition's documents are through, its open windows are closed
with the cuts that the contract allows: pieces of the emptiest windows fill up the fullest ones, and what remains at the
end is cut into windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from barline.llm._spark import ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Levels:
    """The level array, and the open windows behind each of its counts."""

    def __init__(self, capacity: int):
        self.capacity, self.counts = capacity, np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int, new: int) -> tuple[int, int]:
        """(window, offset) for a piece of `size` tokens below the capacity; `new` names the window if one is opened."""
        room = self.capacity - size
        counts = self.counts
        # Growth of the sum of squares: a window leaves level h and arrives at h + size; a full window is no longer counted.
        growth = 1 - 2 * counts[1 : room + 1]
        growth[: room - 1] += 1 + 2 * counts[size + 1 : self.capacity]
        growth[counts[1 : room + 1] == 0] = np.iinfo(np.int64).max
        level = len(growth) - int(np.argmin(growth[::-1])) if len(growth) else 0  # of equals, the fullest
        if not level or growth[level - 1] > 1 + 2 * counts[size]:
            self.counts[size] += 1
            self.open[size].append(new)
            return new, 0
        self.counts[level] -= 1
        window = self.open[level].pop()
        if level < room:
            self.counts[level + size] += 1
            self.open[level + size].append(window)
        return window, level


def close(windows: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Pieces (document, start, length) of open windows, cut anew: full windows, then powers of two for the rest."""
    windows = sorted(windows, key=lambda w: -sum(p[2] for p in w))
    fill = [sum(p[2] for p in w) for w in windows]
    done, low, last = [], 0, len(windows) - 1
    while low < last:
        room = capacity - fill[low]
        while room and low < last:
            doc, start, length = windows[last].pop()
            take = min(room, length)
            windows[low].append((doc, start + length - take, take))
            if take < length:
                windows[last].append((doc, start, length - take))
            room, fill[last] = room - take, fill[last] - take
            fill[low] += take
            last -= not windows[last]
        if not room:
            done.append(windows[low])
            low += 1
    if low == last:
        rest, size = windows[low], fill[low]
        while size:
            part, room = [], 1 << (size.bit_length() - 1)
            size -= room
            while room:
                doc, start, length = rest.pop()
                take = min(room, length)
                part.append((doc, start + length - take, take))
                if take < length:
                    rest.append((doc, start, length - take))
                room -= take
            done.append(part)
    return done


@lru_cache(maxsize=2)
def _encoder(name: str):
    """A function from text to ids. The rank file of the same vocabulary gives the same ids several times faster; texts with a
    special token's own spelling go to the tokenizer file itself."""
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    with open(P.path(name.replace(".json", ".tiktoken")), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast, exact = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(P.path(name))
    return lambda text: exact.encode(text, add_special_tokens=False).ids if "<|endoftext|>" in text else fast.encode_ordinary(text)


def pack_partition(batches: Iterator[pa.RecordBatch], capacity: int, tokenizer: str) -> Iterator[pa.RecordBatch]:
    """Packs the documents of one partition in the order in which they come."""
    encode, levels, first = _encoder(tokenizer), Levels(capacity), TaskContext.get().partitionId() << 40
    opened: dict[int, list[tuple[int, int, int]]] = {}  # windows that may still take a piece
    tails: dict[int, tuple[int, np.ndarray, int, int]] = {}  # documents with a piece in one of them: id, tail ids, its start, length
    n, k = 0, 0
    out: list[tuple] = []

    def emit(document: int, start: int, length: int, window: int, offset: int) -> None:
        doc, tail, at, total = tails[document]
        out.append((doc, start, length, zlib.crc32(tail[start - at : start - at + length].tobytes()), total, first + window, offset))

    def emit_all(pieces: list[tuple[int, int, int]], window: int) -> None:
        offset = 0
        for document, start, length in pieces:
            emit(document, start, length, window, offset)
            offset += length

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 7
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    for documents in batches:
        for doc, text in zip(documents["doc_id"].to_pylist(), documents["text"], strict=True):
            tokens = np.array([*encode(text.as_py() or ""), 0], "<u4")
            whole = len(tokens) // capacity * capacity
            for start in range(0, whole, capacity):
                out.append((doc, start, capacity, zlib.crc32(tokens[start : start + capacity].tobytes()), len(tokens), first + n, 0))
                n += 1
            if size := len(tokens) - whole:
                k += 1
                tails[k] = doc, tokens[whole:].copy(), whole, len(tokens)
                window, offset = levels.place(size, n)
                n += window == n
                opened.setdefault(window, []).append((k, whole, size))
                if offset + size == capacity:
                    emit_all(closed := opened.pop(window), window)
                    for piece in closed:
                        del tails[piece[0]]
        yield batch()
    for pieces in close(list(opened.values()), capacity):
        emit_all(pieces, n)
        n += 1
    yield batch()


def pack(documents: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every partition of the input packs its own documents, without a shuffle; a task holds its open windows only.
    Window numbers are (partition << 40) + count, the same in every attempt of a task. A window is padded to `capacity`
    unless its length is a power of two, so at most the pads of no window remain.

    Null and empty texts are the single end token 0. Repeated rows are packed one by one. Rows with a null id leave.
    An empty table gives no rows; further columns are not read.
    """
    rows = ids(documents, id_column, text_column)
    return rows.mapInArrow(lambda batches: pack_partition(batches, capacity, tokenizer), SCHEMA)
