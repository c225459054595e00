"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text is escaped as the model expects (blanks become U+2581, one stands in front) and cut into words before each run of
U+2581; no piece of the vocabulary crosses such a cut. In a word, the agenda holds every two neighbouring pieces that form a
piece; the best score, and of equals the leftmost, is merged first. Each candidate is skipped for good if a hash of
(seed, word, variant, span) falls below the dropout. The variant of an occurrence is a hash of (seed, document, place), so every
occurrence draws a segmentation of its own, and all of them come back alike on every run. `variants` folds the hash to so many values.

Agendas of many words are worked off together, one merge a word in each round; very long words have a heap of their own.
Characters without a piece, and U+2581 itself, become byte pieces, so decoding returns the text exactly.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barline.llm._repeats import prefix, ragged, span_hash
from barline.llm._spark import ids
from barline.llm._text import mix, pieces

BLANK, LITERAL = 0x2581, 0x110000  # U+2581, and what stands for it where the text itself has it
LONG = 64  # characters of a word beyond which it has a heap of its own
PIECE = 1 << 21  # bytes of text that are worked on at once
_NEVER = np.iinfo(np.int32).max


def _slot(key: np.ndarray, factor: int, size: int) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(factor)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _tables(keys: np.ndarray, merges: dict[int, int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(factor, keys, pieces) of hash tables without chains: what finds its slot taken goes to the next, smaller table."""
    out, factor = [], 0x9E3779B97F4A7C15
    while len(keys):
        size = 1 << (8 * len(keys)).bit_length()
        slot = _slot(keys, factor, size)
        _, one = np.unique(slot, return_index=True)
        held, merged = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        held[slot[one]], merged[slot[one]] = keys[one], [merges[k] for k in keys[one].tolist()]
        out.append((factor, held, merged))
        keys, factor = np.delete(keys, one), mix(np.array([factor], np.uint64))[0].item() | 1
    return out


class Vocabulary:
    """Pieces, the merges that lead to them, and each piece's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        text = [model.id_to_piece(i) for i in range(n)]
        known = {text[i]: i for i in range(n) if plain[i]}
        if any(chr(BLANK) in t.lstrip(chr(BLANK)) for t in known):
            raise ValueError("the vocabulary has pieces that cross words")
        self.bytes_at = np.zeros(256, np.int64)
        raw = [t.replace(chr(BLANK), " ").encode() if p else b"" for t, p in zip(text, plain, strict=True)]
        for i in range(n):
            if model.is_byte(i):
                value = int(text[i][3:5], 16)
                self.bytes_at[value], raw[i] = i, bytes([value])
        self.single = np.full(LITERAL + 1, -1, np.int64)
        for t, i in known.items():
            if len(t) == 1:
                self.single[ord(t)] = i
        self.single[LITERAL] = -1
        rank = np.argsort(np.argsort([-model.get_score(i) for i in range(n)], kind="stable"), kind="stable")
        merges = {(known[t[:k]] << 32 | known[t[k:]]): i for t, i in known.items() for k in range(1, len(t)) if t[:k] in known and t[k:] in known}
        self.tables = _tables(np.array(sorted(merges), np.int64), merges)
        self.rank = rank.astype(np.int32)
        self.table = merges
        self.text = np.frombuffer(b"".join(raw), np.uint8)
        self.ends = np.cumsum([len(r) for r in raw])
        self.sizes = np.array([len(r) for r in raw], np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece of each two neighbours, or -1."""
        key = a.astype(np.int64) << 32 | b
        out = np.full(len(key), -1, np.int32)
        for factor, keys, merged in self.tables:
            slot = _slot(key, factor, len(keys))
            out = np.where(keys[slot] == key, merged[slot], out)
        out[(a < 0) | (b < 0)] = -1
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _skipped(word: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate that joins [start, middle) and [middle, end) of a word is skipped; `word` has seed, word and variant in it."""
    u = np.uint64
    h = mix(word + start.astype(u) * u(0x9E3779B97F4A7C15) + middle.astype(u) * u(0xC2B2AE3D27D4EB4F) + end.astype(u) * u(0x165667B19E3779F9))
    return (h >> u(11)).astype(np.float64) * 2.0**-53 < dropout


def _agenda(v: Vocabulary, base: list[int], word: int, dropout: float) -> list[int]:
    """One long word, by a heap of candidates."""
    n = len(base)
    piece, after, before, end = list(base), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []
    key = np.array([word], np.uint64)

    def offer(i: int) -> None:
        j = after[i]
        if j < n and piece[i] >= 0 and piece[j] >= 0 and (m := v.table.get(piece[i] << 32 | piece[j])) is not None and not (dropout and _skipped(key, *(np.array([x]) for x in (i, j, end[j])), dropout)[0]):
            heapq.heappush(heap, (int(v.rank[m]), i, j, end[j], m))

    for i in range(n):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, j, e, m = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or after[i] != j or end[j] != e or v.table.get(piece[i] << 32 | piece[j]) != m:
            continue
        alive[j] = False
        piece[i], after[i], end[i] = m, after[j], e
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p, a in zip(piece, alive, strict=True) if a]


def _merge(v: Vocabulary, base: np.ndarray, sizes: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of words laid end to end, and their number in each word."""
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    begin = (np.arange(len(base)) - (np.cumsum(sizes) - sizes)[word]).astype(np.int32)
    piece, end = base.astype(np.int32), begin + 1
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def candidates(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece and rank of the pairs (at, at + 1)."""
        at2 = np.minimum(at + 1, len(piece) - 1)
        m = np.where((at2 > at) & (word[at2] == word[at]), v.pair(piece[at], piece[at2]), -1)
        hit = np.flatnonzero(m >= 0)
        if dropout and len(hit):
            m[hit[_skipped(keys[word[at[hit]]], begin[at[hit]], end[at[hit]], end[at2[hit]], dropout)]] = -1
        return m, np.where(m >= 0, v.rank[m], _NEVER)

    merged, rank = candidates(np.arange(len(piece)))
    while len(piece):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(piece))))
        over = best == _NEVER
        if 4 * np.count_nonzero(over) > len(over) or over.all():  # ended words leave together
            done.append((word[over], begin[over], piece[over]))
            word, begin, end, piece, merged, rank = (x[~over] for x in (word, begin, end, piece, merged, rank))
            continue
        hits = np.flatnonzero((rank == best) & ~over)
        at = hits[np.concatenate(([True], word[hits][1:] != word[hits][:-1]))]  # the leftmost
        piece[at], end[at] = merged[at], end[at + 1]
        stay = np.ones(len(piece), bool)
        stay[at + 1] = False
        moved = at - np.arange(len(at))
        word, begin, end, piece, merged, rank = (x[stay] for x in (word, begin, end, piece, merged, rank))
        touched = np.zeros(len(piece), bool)
        touched[moved] = True
        touched[moved[(moved > 0) & (word[moved - 1] == word[moved])] - 1] = True
        again = np.flatnonzero(touched)
        merged[again], rank[again] = candidates(again)
    if not done:
        return base[:0], np.zeros(len(sizes), np.int64)
    word, begin, piece = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.lexsort((begin, word))
    return piece[order], np.bincount(word, minlength=len(sizes))


def _to_bytes(v: Vocabulary, piece: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece, held as -2 - code, spelled in byte pieces."""
    odd = np.flatnonzero(piece < 0)
    if not len(odd):
        return piece, count
    code = -2 - piece[odd]
    raw = [chr(BLANK if c == LITERAL else c).encode() for c in code.tolist()]
    size = np.ones(len(piece), np.int64)
    size[odd] = [len(r) for r in raw]
    out = np.repeat(piece, size)
    begin = np.cumsum(size) - size
    out[ragged(begin[odd], size[odd])] = v.bytes_at[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(count)), count)
    return out, np.bincount(owner, size, len(count)).astype(np.int64)


def encode(v: Vocabulary, texts: list[str], docs: np.ndarray, seed: int, dropout: float, variants: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts laid end to end, and their number in each text. Empty texts have none."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    codes = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), np.uint32).astype(np.int64)
    if not len(codes):
        return np.zeros(0, np.int64), sizes * 0
    codes = np.where(codes == BLANK, LITERAL, np.where(codes == 0x20, BLANK, codes))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    cut = np.concatenate(([True], (codes[1:] == BLANK) & (codes[:-1] != BLANK)))
    cut[offsets[:-1][sizes > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(codes))
    owner = np.searchsorted(offsets, starts, "right") - 1
    place = np.arange(len(starts)) - np.searchsorted(owner, owner)
    u = np.uint64
    name = span_hash(prefix(codes, 0x9E3779B97F4A7C15), starts, ends, 0x9E3779B97F4A7C15)
    variant = mix(docs[owner].astype(u) * u(0xD1342543DE82EF95) + place.astype(u) * u(0x2545F4914F6CDD1D) + u(seed & 0xFFFFFFFF)) if dropout else np.zeros(len(starts), u)
    if variants is not None:
        variant %= u(variants)
    key = mix(name + variant * u(0xA0761D6478BD642F) + u(seed & 0xFFFFFFFF) * u(0xE7037ED1A0B428DB))
    _, one, inverse = np.unique(key, return_index=True, return_inverse=True)
    s, n = starts[one], ends[one] - starts[one]
    base = v.single[codes[ragged(s, n)]]
    base = np.where(base < 0, -2 - codes[ragged(s, n)], base)
    short = n <= LONG
    which = np.repeat(short, n)
    piece, count = _merge(v, base[which], n[short], key[one][short], dropout)
    if not short.all():
        long = [_agenda(v, base[a : a + k].tolist(), int(key[one][i]), dropout) for i, a, k in zip(np.flatnonzero(~short), (np.cumsum(n) - n)[~short], n[~short], strict=True)]
        piece, all_counts = np.concatenate([piece, *map(np.array, long)]), np.zeros(len(n), np.int64)
        all_counts[short], all_counts[~short] = count, [len(x) for x in long]
        begin = np.empty(len(n), np.int64)
        arranged = np.concatenate((np.flatnonzero(short), np.flatnonzero(~short)))
        begin[arranged] = np.cumsum(all_counts[arranged]) - all_counts[arranged]
        piece, count = piece[ragged(begin, all_counts)], all_counts
    piece, count = _to_bytes(v, piece, count)
    begin = np.cumsum(count) - count
    out = piece[ragged(begin[inverse], count[inverse])]
    return out, np.bincount(owner, count[inverse], len(texts)).astype(np.int64)


def decode(v: Vocabulary, found: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """UTF-8 bytes of each text's ids."""
    size = v.sizes[found]
    raw = v.text[ragged(v.ends[found] - size, size)].tobytes()
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
    return [raw[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _path(model: str) -> str:
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def encode_documents(documents: DataFrame, seed: int = 1, dropout: float = 0.1, variants: int | None = None, model: str = "piece_bpe_32k.model", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids (array<int>) and decoded_sha256 (of the text that the ids decode to) of every document.

    Without dropout the ids are the model's own. Null and empty texts have no ids. Rows that repeat are encoded alike; rows with a
    null id leave. An empty table gives no rows; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(_path(model))
        for batch in batches:
            for row, end, data, offsets in pieces(batch["text"], PIECE):
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                doc = batch["doc_id"][row:end]
                found, counts = encode(v, texts, doc.to_numpy(zero_copy_only=False), seed, dropout, variants)
                back = [hashlib.sha256(x).hexdigest() for x in decode(v, found, counts)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.diff(offsets)), pa.array(counts), lists, pa.array(back)], names=["doc_id", "n_bytes", "n_pieces", "ids", "decoded_sha256"])

    return ids(documents, id_column, text_column).mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids array<int>, decoded_sha256 string")


def decode_documents(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(_path(model))
        for batch in batches:
            lists = batch["ids"].to_pylist()
            flat = np.array([i for x in lists for i in x or ()], np.int64)
            texts = decode(v, flat, np.array([len(x or ()) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([None if x is None else t.decode() for x, t in zip(lists, texts, strict=True)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
