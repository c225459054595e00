"""Removal of repeated byte strings through suffix arrays, sorted deep-shallow.

The suffixes of a bucket (see _repeats) are sorted in two regimes. Multikey quicksort, down to a shallow depth, takes eight bytes
at a time as one symbol: every group of suffixes is split three ways by the median of three of its symbols; the middle part, which
agrees in the symbol, goes on one symbol deeper. Groups that still tie at the shallow depth share long prefixes; comparing them symbol by symbol
would read the same bytes again and again. Their order comes from blind tries, which branch only where suffixes differ: a group's first
suffix is a path from the root to a leaf, each other suffix leaves it at its first different byte, and the suffixes that leave at the
same place by the same byte form the subtrie there. In-order, what leaves by smaller bytes comes before the path, from the top down, and what
leaves by larger ones behind it, from the bottom up.

All groups of a task are split at once, and all tries grow by one path at a time, by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm._repeats import HOT, numbered, ragged, remove_repeats

SHALLOW = 32  # bytes that multikey quicksort looks at
_WORD = 8


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one big-endian number; zeros stand behind the end."""
    padded = np.concatenate((data, np.zeros(_WORD, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(_WORD):
        out |= padded[i : i + len(data)] << np.uint64(8 * (7 - i))
    return out


def _first_byte(x: np.ndarray) -> np.ndarray:
    """Place (0 to 7) of the first byte that is not 0 in big-endian words other than 0."""
    out = np.zeros(len(x), np.int64)
    for i in range(1, _WORD):
        out += x < np.uint64(1 << (64 - 8 * i))
    return out


def _groups(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """Group numbers of sorted rows: a new one wherever a key changes."""
    change = np.zeros(len(sorted_keys[0]), bool)
    for key in sorted_keys:
        change[1:] |= key[1:] != key[:-1]
    return np.cumsum(change)


def multikey_quicksort(word: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings at these places by their first `depth` bytes, and for each position of the order where its group of ties begins."""
    n = len(places)
    order, slot, at_depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    tied = np.arange(n)  # positions of groups of two or more that are not through
    while len(tied):
        group, deep = slot[tied], at_depth[tied]
        key = word[places[order[tied]] + deep]
        past = deep + _WORD - depth
        if (past > 0).any():
            key = key >> (8 * np.maximum(past, 0)).astype(np.uint64)
        first = np.flatnonzero(group == tied)
        size = np.diff(np.append(first, len(tied)))
        three = np.sort(np.stack((key[first], key[first + size // 2], key[first + size - 1])), 0)
        pivot = np.repeat(three[1], size)
        less, same = key < pivot, key == pivot
        counts = [np.add.reduceat(x.astype(np.int64), first) for x in (less, same)]
        n_less, n_same = (np.repeat(c, size) for c in counts)
        rank = lambda x: (lambda c: c - 1 - np.repeat((c - x)[first], size))(np.cumsum(x))  # noqa: B023, E731
        begin = np.where(less, 0, np.where(same, n_less, n_less + n_same))
        to = group + begin + np.where(less, rank(less), np.where(same, rank(same), rank(~(less | same))))
        order[to] = order[tied]
        slot[to] = group + begin
        at_depth[to] = deep + _WORD * same
        ends = np.append(np.flatnonzero(np.diff(slot[tied])), len(tied) - 1)
        many = np.repeat(np.diff(np.append(-1, ends)) > 1, np.diff(np.append(-1, ends)))
        tied = tied[many & (at_depth[tied] < depth)]
    return order, slot


def sort_suffixes(data: np.ndarray, places: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings data[place : place + length], and for each string in that order the number of its class of equals."""
    n = len(places)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _words_at(data)
    order, slot = multikey_quicksort(word, places, min(shallow, length))
    size = np.bincount(slot, minlength=n)
    tied = np.flatnonzero(size[slot] > 1) if shallow < length else np.zeros(0, np.int64)

    def arrange(at: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """Sorts the tied strings at these positions of the order by their slot, then by the keys; returns which positions still tie."""
        rank = np.lexsort((*reversed(keys), slot[at]))
        order[at] = order[at][rank]
        group = _groups([slot[at][rank], *(k[rank] for k in keys)])
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        slot[at] = at[begin][group]
        size = np.diff(np.append(begin, len(at)))
        return at[(size > 1)[group]]

    depth_of = np.full(n, min(shallow, length))  # by slot: bytes in which a group agrees
    while len(tied):
        group = slot[tied]
        pivot, own, depth = places[order[group]], places[order[tied]], depth_of[group]
        common = np.full(len(tied), length)
        live = np.flatnonzero(group != tied)  # the pivot is the trie's path
        at = depth[live]
        while len(live):
            off = word[own[live] + at] ^ word[pivot[live] + at]
            split = off != 0
            common[live[split]] = np.minimum(length, at[split] + _first_byte(off[split]))
            live, at = live[~split], at[~split] + _WORD
            live, at = live[at < length], at[at < length]
        leaf = common < length
        mine = np.where(leaf, data[np.minimum(own + common, len(data) - 1)], 0).astype(np.int64)
        path = np.where(leaf, data[np.minimum(pivot + common, len(data) - 1)], 0).astype(np.int64)
        # Smaller strings leave the path from the top down before it, larger ones from the bottom up behind it.
        side = np.where(~leaf, 0, np.where(mine < path, -1, 1))
        place = np.where(side < 0, common, -common)
        rank = np.lexsort((mine, place, side, group))
        still = arrange(tied, [side, place, mine])
        depth_of[slot[tied]] = np.where(leaf, common + 1, length)[rank]
        tied = still[depth_of[slot[still]] < length]
    return order, slot


def earlier_equal(data: np.ndarray, places: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Which strings have an equal one with a smaller (doc, start): all of a class in the suffix array but its first."""
    order, group = sort_suffixes(data, places, length)
    out = np.zeros(len(places), bool)
    many = np.concatenate((group[1:] == group[:-1], [False])) | np.concatenate(([False], group[1:] == group[:-1])) if len(group) else np.zeros(0, bool)
    order, group = order[many], group[many]
    within = np.lexsort((start[order], doc[order], group))
    order, group = order[within], group[within]
    if len(order):
        edge = np.concatenate(([True], group[1:] != group[:-1]))
        lead = order[np.maximum.accumulate(np.where(edge, np.arange(len(order)), 0))]
        out[order] = ~edge & ((doc[order] != doc[lead]) | (start[order] != start[lead]))
    return out


def same_bytes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray, other_begin: np.ndarray, other_end: np.ndarray, edges: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of stretches lie in strings of `length` bytes that fall into one class with the string at the same place of their source.

    The strings follow one another from each stretch's first byte, the last one ending with the stretch; those of stretches and sources are
    sorted together.
    """
    size = np.diff(np.append(edges, len(begin)))
    count = -(-size // length)
    starts = np.minimum(np.repeat(edges, count) + length * ragged(np.zeros(len(edges), np.int64), count), np.repeat(edges + size - length, count))
    both = np.concatenate((data[begin], other[other_begin]))
    order, group = sort_suffixes(both, np.concatenate((starts, starts + len(begin))), length)
    of = np.empty(len(order), np.int64)
    of[order] = group
    equal = of[: len(starts)] == of[len(starts) :]
    out = np.zeros(len(begin), bool)
    out[ragged(starts[equal], np.full(equal.sum(), length))] = True
    return out


def dedup_bytes(documents: DataFrame, length: int = 100, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, tie, n (bytes), n_removed, spans (start and end of the maximal removed runs) and kept (the other bytes).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a smaller id, or in the same
    document at a smaller place; strings never cross documents and are judged on the input. Null and empty texts have
    nothing to remove. Rows that share an id are judged one by one, and a string in one of them is earlier than one in
    another only if it starts at a smaller place; equal rows fare alike. Rows with a null id leave. An empty table gives no
    rows; further columns are not read.
    """
    gram = max(1, min(32, length // 2))
    return remove_repeats(documents, "bytes", length, gram, earlier_equal, same_bytes, id_column, text_column, hot)


def dedup_texts(documents: DataFrame, length: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, after dedup_bytes: the text without its repeated bytes.

    Characters of which a part is removed go as a whole. Null texts and rows with a null id stay as they are.
    """
    found = dedup_bytes(documents, length, id_column, text_column).where("n_removed > 0")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept.decode("utf-8", "ignore") for kept in batch["kept"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tie"], pa.array(texts, pa.string())], names=["doc_id", "tie", "new"])

    new = found.select("doc_id", "tie", "kept").mapInArrow(decode, "doc_id long, tie int, new string").dropDuplicates(["doc_id", "tie"])
    rows = numbered(documents, id_column, text_column, whole=True).drop("text").join(new, ["doc_id", "tie"], "left")
    text = F.coalesce("new", F.col("row")[text_column])
    return rows.select(*[text.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in documents.columns])
