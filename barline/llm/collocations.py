"""Collocations: phrases whose words occur together far more often than their parts would by chance, for each language.

1. Every task counts the phrases of its documents in a count-min sketch (rows of counters that stop at `least`). The sketches are
   added up. A counter holds at least the count of each phrase that falls on it, so a phrase with a counter below `least` in
   any row is not frequent; all others survive. What goes back to the tasks is one bit a counter.
2. A second pass aggregates the survivors exactly, by their words. Parts of a frequent phrase are as frequent at least, so
   they are among the survivors, too.
3. Phrases are scored by their weakest cut, and those that mostly occur inside a longer one leave.

The sketch grows with the corpus until a row has MOST counters (at 1 GB of text by default; the bits that are sent are 16 MB
then). Beyond that more of the rare phrases survive and the second pass aggregates more; no result depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm._spark import cut, tidy
from barline.llm._text import hashes, lower, mix, pieces

ROWS, LEAST_BITS, MOST_BITS = 2, 16, 26  # rows of the sketch; binary logarithms of a row's counters
BYTES = 16  # of text for each counter of a row
BLOCK = 1 << 17  # counters that travel as one value
PIECE, SKETCH_PIECE = 1 << 21, 1 << 20  # bytes of text that are worked on at once; the first step also holds a sketch
HASHED = (1 << 18) - 1  # bytes that are hashed at once; a hash takes dozens of bytes for each
HOT = 1000  # a part is hot if more than one in HOT cuts have it
SALTS = 8  # parts of the phrases of a language
UNKNOWN = "und"
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _BREAK.copy()
_BETWEEN[[0x20, 0x09]] = True


class Words:
    """Words of texts laid end to end, and the places where phrases of 1, 2, .. words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, longest: int):
        data = lower(data)
        inside = ~_BETWEEN[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
        self.ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        self.data, self.inside = data, inside
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        breaks = np.cumsum(_BREAK[data], dtype=np.int32)[self.starts]
        joined = (breaks[1:] == breaks[:-1]) & (self.row[1:] == self.row[:-1])
        joined = np.concatenate((joined, np.zeros(longest, bool)))  # whether a word and the next lie in one phrase
        self.begins = [np.arange(len(self.starts))]
        for k in range(longest - 1):
            self.begins.append(self.begins[-1][joined[self.begins[-1] + k]])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, made from as many words at once as lie in HASHED bytes, one at least."""
        out, i, n = np.empty(len(self.starts), np.uint64), 0, len(self.starts)
        while i < n:
            low = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, low + HASHED, "right")))
            out[i:j] = hashes(self.data[low : self.ends[j - 1]], self.starts[i:j] - low, self.ends[i:j] - low)
            i = j
        return out

    def phrase_hashes(self, language: np.ndarray) -> list[np.ndarray]:
        """A 64-bit hash of language and words of every phrase, by its length; equal phrases have equal hashes."""
        factor = np.uint64(0x9E3779B97F4A7C15)
        word = self.hashes()
        total, out = language[self.row] * factor + word, []
        for k, at in enumerate(self.begins):
            if k:
                total = total[:-1] * factor + word[k:]
            out.append(mix(total[at]))
        return out

    def dictionary(self) -> tuple[np.ndarray, pa.Array]:
        """Each word's number, and the distinct words."""
        ends = np.concatenate(([0], np.cumsum(self.ends - self.starts))).astype(np.int64)
        cells = pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(ends), pa.py_buffer(self.data[self.inside])).dictionary_encode()
        return cells.indices.to_numpy().astype(np.int64), cells.dictionary


def _languages(batch: pa.RecordBatch, row: int, end: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each text's language as a number, the distinct languages, and a hash of each."""
    cells = batch["lang"][row:end].dictionary_encode()
    names = cells.dictionary
    raw = [np.frombuffer(x.encode(), np.uint8) for x in names.to_pylist()]
    ends = np.cumsum([0, *map(len, raw)])
    return cells.indices.to_numpy().astype(np.int64), names, hashes(np.concatenate(raw) if raw else np.zeros(0, np.uint8), ends[:-1], ends[1:])


def _parts(batches: Iterator[pa.RecordBatch], longest: int, size: int) -> Iterator[tuple[Words, np.ndarray, pa.Array, np.ndarray]]:
    for batch in batches:
        for row, end, data, offsets in pieces(batch["text"], size):
            number, names, hashed = _languages(batch, row, end)
            yield Words(data, offsets, longest), number, names, hashed


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each hash in a row of the sketch."""
    return (h >> np.uint64(64 - bits * (row + 1)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _times(at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places in order, and how often each occurs, `least` at most."""
    at = np.sort(at)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(at), 1), bool), at[1:] != at[:-1])))
    return at[first], np.minimum(np.diff(np.append(first, len(at))), least).astype(np.uint8)


def count(row: np.ndarray, at: np.ndarray, least: int) -> None:
    """Adds every place to a row of the sketch; counters stop at `least`."""
    at, times = _times(at, least)
    row[at] = np.minimum(row[at] + times, np.uint8(least))


def count_packed(row: np.ndarray, at: np.ndarray, least: int) -> None:
    """As `count`, in a row of half the bytes: each has a counter of the first half and one of the second. `least` is 15 at most."""
    at, times = _times(at, least)
    middle = int(np.searchsorted(at, len(row)))
    have = row[low := at[:middle]]
    row[low] = have & np.uint8(0xF0) | np.minimum((have & np.uint8(15)) + times[:middle], np.uint8(least))
    have = row[high := at[middle:] - np.uint32(len(row))]
    row[high] = have & np.uint8(15) | np.minimum((have >> np.uint8(4)) + times[middle:], np.uint8(least)) << np.uint8(4)


def unpacked(row: np.ndarray, first: int, end: int) -> np.ndarray:
    """Counters first .. end - 1 of such a row, one in a byte."""
    n = len(row)
    return np.concatenate((row[first:end] & np.uint8(15), row[max(first - n, 0) : max(end - n, 0)] >> np.uint8(4)))


def _sketch(batches: Iterator[pa.RecordBatch], bits: int, least: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Step 1, in the task that reads the texts: its counters, block by block."""
    packed = least < 16
    held, add = np.zeros((ROWS, 1 << bits >> packed), np.uint8), count_packed if packed else count
    for words, number, _, hashed in _parts(batches, longest, SKETCH_PIECE):
        h = np.concatenate(words.phrase_hashes(hashed[number] if len(hashed) else np.zeros(len(number), np.uint64)))
        for k in range(ROWS):
            add(held[k], cells(h, k, bits), least)
    size, codec = min(BLOCK, 1 << bits), pa.Codec("zstd", 1)
    for first in range(0, ROWS << bits, 16 * size):
        places, counters = [], []
        for i in range(first, min(first + 16 * size, ROWS << bits), size):
            row, at = held[i >> bits], i & (1 << bits) - 1
            own = unpacked(row, at, at + size) if packed else row[at : at + size]
            if own.any():
                places.append(i // size)
                counters.append(codec.compress(own, asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(counters, pa.binary())], names=["block", "counters"])
    del held, row, own
    tidy()


def _merge(batches: Iterator[pa.RecordBatch], size: int, least: int) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of a partition, of which only the bits stay: whether a counter reached `least`."""
    total: dict[int, np.ndarray] = {}
    codec = pa.Codec("zstd")
    for batch in batches:
        for block, raw in zip(batch["block"].to_pylist(), batch["counters"], strict=True):
            own = np.frombuffer(codec.decompress(raw.as_buffer(), size), np.uint8)
            have = total.get(block)
            total[block] = own.copy() if have is None else np.minimum(have + own, least, out=have)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(x >= least).tobytes() for x in total.values()], pa.binary())], names=["block", "bits"])


def survivors(rows: DataFrame, least: int, longest: int, most_bits: int = MOST_BITS) -> tuple[int, bytes]:
    """The sketch of (lang, text): the logarithm of a row's counters, and a bit for each counter that reached `least`. `least` is 127 at most."""
    if not 0 < least < 128:
        raise ValueError("counters hold up to 127")
    spark = rows.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(most_bits, max(LEAST_BITS, (size // BYTES).bit_length()))
    # A sketch for each of two tasks a core: what they send doesn't grow with the number of files.
    own = rows.coalesce(max(8, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(lambda x: _sketch(x, bits, least, longest), "block int, counters binary")
    out = bytearray(ROWS << bits >> 3)
    block = min(BLOCK, 1 << bits)
    for r in own.repartition("block").mapInArrow(lambda x: _merge(x, block, least), "block int, bits binary").collect():
        out[r["block"] * block >> 3 : (r["block"] + 1) * block >> 3] = r["bits"]
    return bits, bytes(out)


def _exact(batches: Iterator[pa.RecordBatch], sketch: tuple[int, np.ndarray], longest: int) -> Iterator[pa.RecordBatch]:
    """Step 2: how often each surviving phrase occurs in a part of the text, and its number of words under size 0."""
    bits, reached = sketch
    for words, number, names, hashed in _parts(batches, longest, PIECE):
        own = number[words.row]
        lang, size, phrase, times = [names], [np.zeros(len(names), np.int32)], [pa.array([""] * len(names), pa.large_string())], [np.bincount(own, minlength=len(names))]
        which, distinct = words.dictionary()
        # Phrases get numbers from those that they begin with, so no hash decides what is equal.
        _, rank = np.unique(own << 32 | which, return_inverse=True)
        for k, (at, h) in enumerate(zip(words.begins, words.phrase_hashes(hashed[number] if len(hashed) else np.zeros(len(number), np.uint64)), strict=True)):
            for row in range(ROWS):
                cell = cells(h, row, bits).astype(np.int64) + (row << bits)
                keep = (reached[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                at, h = at[keep], h[keep]
            if k:  # a frequent phrase begins with one that has survived
                at = at[name[at] >= 0]
            key = rank[at] if not k else name[at] << 32 | rank[at + k]
            _, one, turn, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            name = np.full(len(which), -1, np.int64)
            name[at] = turn
            spot = at[one]
            columns = [distinct.take(pa.array(which[spot + i])) for i in range(k + 1)]
            lang.append(names.take(pa.array(own[spot])))
            size.append(np.full(len(spot), k + 1, np.int32))
            phrase.append(pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())))
            times.append(n)
        size, times = np.concatenate(size), np.concatenate(times).astype(np.int64)
        lang, phrase = pa.chunked_array(lang).combine_chunks(), pa.chunked_array(phrase).combine_chunks().cast(pa.string())
        for i in range(0, len(size), 1 << 16):
            to = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([lang[to], pa.array(size[to]), phrase[to], pa.array(times[to])], names=["lang", "size", "phrase", "n"])
    tidy()


def counts(documents: DataFrame, least: int = 10, longest: int = 3, most_bits: int = MOST_BITS, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, size, phrase, n of all phrases of up to `longest` words that occur `least` times in their language; under size 0 and '' each language's number of words.

    Words are those of the lower-cased (A-Z) text between blanks, tabs, line ends and `.,;:!?`; phrases don't reach across the last two kinds.
    Null languages are `und`; null and empty texts have no words. Repeated rows count each. An empty table gives no rows.
    """
    rows = documents.select(F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_column).cast("string").alias("text")).where("text is not null")
    bits, raw = survivors(rows, least, longest, most_bits)
    sent = rows.sparkSession.sparkContext.broadcast(raw)  # ROWS << most_bits bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _exact(batches, (bits, np.frombuffer(sent.value, np.uint8)), longest)

    found = rows.mapInArrow(run, "lang string, size int, phrase string, n long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0) & (F.col("n") > 0))


def _counted(cuts: DataFrame, parts: DataFrame, part: str, name: str) -> DataFrame:
    """cuts with the count of a part as `name`.

    Parts that more than one in HOT cuts have are fewer than HOT; their counts are broadcast, and in the join by part those cuts go by their own phrase.
    """
    uses = cuts.groupBy("lang", part).agg(F.count("*").alias("uses"))
    whole = uses.agg(F.sum("uses").alias("whole"))  # one row
    own = parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    hot = uses.crossJoin(F.broadcast(whole)).where(F.col("uses") * HOT > F.col("whole")).join(own, ["lang", part]).select("lang", part, F.col(name).alias("_hot"))
    keyed = cuts.join(F.broadcast(hot), ["lang", part], "left").withColumn("_key", F.when(F.col("_hot").isNull(), F.col(part)).otherwise(F.col("phrase")))
    found = keyed.join(own.withColumnRenamed(part, "_key"), ["lang", "_key"], "left")
    return found.withColumn(name, F.coalesce("_hot", name)).drop("_key", "_hot", part)


def _words(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, score of each counted phrase of two words or more: floor(1000000 a a / (l r)) of its lowest-scoring cut, of equals the first."""
    phrases = found.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _words(1, F.col("k")).alias("first"), _words(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = _counted(cuts, found.where("size > 0"), part, name)
    score = F.expr("(cast(1000000 as decimal(38, 0)) * cast(a as decimal(19, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    weakest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(weakest.alias("c")).select("lang", "phrase", "size", "a", "c.*")


def subsumed(phrases: DataFrame, share: tuple[int, int] = (50, 100)) -> DataFrame:
    """Without phrases that lie in a longer one with share[0] / share[1] of their own count at least."""
    inner = phrases.where("size > 2").withColumn("w", F.split("phrase", " ")).withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1))).select("lang", _words(F.col("at"), F.col("n")).alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return phrases.join(most, ["lang", "phrase"], "left").where(f"most is null or cast({share[1]} as decimal(19, 0)) * most < cast({share[0]} as decimal(19, 0)) * a").drop("most")


def collocations(documents: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, share: tuple[int, int] = (50, 100), **options: object) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` by score, then count (both descending), then the phrase's bytes.

    `counts` says what phrases are and how nulls, empty texts and empty tables count. Arithmetic is in decimals of 38 digits.
    """
    found = cut(counts(documents, least, longest, **options))
    kept = subsumed(scored(found), share)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))], ["lang"]):  # a language's phrases are ranked in parts, then the parts' first
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    words = found.where("size = 0").select("lang", "n")
    return kept.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
