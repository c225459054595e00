"""Removal of repeated word sequences by Relative Lempel-Ziv parsing.

A bucket's segments (see _repeats) are its reference block: all stretches of the corpus that may hold equal windows meet
in one block, so every document is factored against every block that can match it and against no other. The block is
indexed by the hash of each window of words. Each segment is then factored greedily: at its place, the block's earliest equal
window is looked up and followed for as long as both agree; the factor is that stretch, and parsing goes on behind it. Where
nothing matches, one word is passed as a literal. A factor of at least a window's length is a duplicate span. Windows that
cross a factor's end belong to no factor, so they are looked up one by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from barline.llm._repeats import HOT, ragged, remove_repeats
from barline.llm._text import runs


class Block:
    """A reference block: its words, and each window's earliest place by (doc, start)."""

    def __init__(self, symbols: np.ndarray, places: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int):
        self.symbols, self.length = symbols, length
        h = runs(symbols, length)[places]
        order = np.lexsort((start, doc, h))
        edge = np.concatenate(([True], h[order][1:] != h[order][:-1]))
        first = order[edge][np.cumsum(edge) - 1]
        self.earliest = np.empty(len(places), np.int64)  # of each window, the window that has it first
        self.earliest[order] = first

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows at two places hold the same words."""
        out = np.ones(len(a), bool)
        for i in range(self.length):
            out &= self.symbols[a + i] == self.symbols[b + i]
        return out


def earlier_equal(symbols: np.ndarray, places: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Which windows have an equal one with a smaller (doc, start), by factoring every segment against the block."""
    out = np.zeros(len(places), bool)
    if not len(places):
        return out
    block = Block(symbols, places, doc, start, length)
    # Windows of one segment stand at neighbouring places; `end` is the number of the first window behind the segment.
    edge = np.concatenate(([True], np.diff(places) != 1))
    begin = np.flatnonzero(edge)
    end_of = np.repeat(np.append(begin[1:], len(places)), np.diff(np.append(begin, len(places))))
    earlier = lambda at: (doc[block.earliest[at]] != doc[at]) | (start[block.earliest[at]] != start[at])
    cursor = begin.copy()  # the next window of every segment that is not through
    while len(cursor):
        source = block.earliest[cursor]
        hit = earlier(cursor) & block.same(places[cursor], places[source])
        out[cursor[hit]] = True
        # Follow the source while the next word agrees: that many windows more lie inside the factor.
        grown, at, of = cursor + 1, cursor[hit], source[hit]
        live, which = np.arange(len(at)), np.flatnonzero(hit)
        step = 1
        while len(live):
            room = (at[live] + step < end_of[at[live]]) & (of[live] + step < end_of[of[live]])
            live = live[room]
            agree = symbols[places[at[live]] + length - 1 + step] == symbols[places[of[live]] + length - 1 + step]
            live = live[agree]
            out[at[live] + step] = True
            grown[which[live]] += 1
            step += 1
        # The window behind a factor crosses its end; it is looked up as the next cursor, and so are all behind a literal.
        cursor = grown[grown < end_of[cursor]]
    return out


def factors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray, other_begin: np.ndarray, other_end: np.ndarray, edges: np.ndarray, length: int) -> np.ndarray:
    """Which words of stretches lie in factors of `length` words or more, each stretch parsed against the block place that the index names for it.

    From its first word on, a stretch is followed for as long as its words equal the block's; the factor ends at the first
    that differs, which is passed as a literal, and parsing goes on behind it. Words are compared by their bytes.
    """
    size = end - begin
    same = size == other_end - other_begin
    at = np.flatnonzero(same & (size > 0))
    cell = size[at]
    apart = data[ragged(begin[at], cell)] != other[ragged(other_begin[at], cell)]
    if len(at):
        same[at] = ~np.logical_or.reduceat(apart, np.cumsum(cell) - cell)
    cut = np.zeros(len(same), bool)
    cut[edges] = True
    head = np.flatnonzero(cut | ~same | np.concatenate(([True], ~same[:-1])) if len(same) else cut)  # a factor or a literal begins
    run = np.diff(np.append(head, len(same)))
    return same & np.repeat(run >= length, run)


def dedup_words(documents: DataFrame, length: int = 20, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, tie, n (words), n_removed, spans (start and end in words) and kept (words joined by a space, UTF-8).

    Words are the runs without white space (space, 0x09 to 0x0D). A word goes if `length` consecutive words that cover it also
    start earlier: in a document with a smaller id, or in the same document at a smaller place; windows never cross documents
    and are judged on the input. Null, empty and short texts have nothing to remove. Rows that share an id are judged one by
    one, and a window in one of them is earlier than one in another only if it starts at a smaller place; equal rows fare
    alike. Rows with a null id leave. An empty table gives no rows; further columns are not read.
    """
    gram = max(1, min(6, length // 2))
    return remove_repeats(documents, "words", length, gram, earlier_equal, factors, id_column, text_column, hot)
