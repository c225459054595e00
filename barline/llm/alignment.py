"""Alignment of a byte-level BPE tokenizer (A) with a SentencePiece one (B) over the same bytes.

Both encode space + text. Byte offsets where a token of A and one of B end together cut the tokens into groups and link the two
tokens. An id pair is packed into one int64 (B's id in the high half), and counted in three steps:

1. Each partition counts its links with np.unique and emits one row a pair.
2. The rows are dealt out by range and sorted by pair; run lengths are summed, so that each partition holds a sorted shard.
3. The shards lie as files in the shared folder, and Spark brings them to every executor. Tasks map them into memory and find counts by searchsorted.

Tokens that end together lie one in the other, so one's bytes are a suffix of the other's. The vocabularies thereby bound the
number of pairs, whatever the corpus (`most_pairs`; 324,297 for the two default ones, 5 MB), and shards can go to every executor.

Neither tokenizer has tokens across a blank that follows a visible character, so texts are cut there and each distinct stretch of
a part of the text is encoded and aligned once. Stretches are told apart by their bytes, not by hashes.
"""

from __future__ import annotations

import io
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm._spark import cut, ids, put, share, tidy
from barline.llm._text import pieces

BLANK = "▁"
PIECE = 1 << 21  # bytes of text that are worked on at once
TOGETHER = 1 << 12  # bytes of stretches that are encoded together
SHARD = 1 << 16  # pairs that a shard's file holds at least, but for the last
HELD = 1 << 20  # entries of partial counts that a task holds before it adds them up
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


class Side:
    """Bytes of each id of a vocabulary laid end to end, and where they begin."""

    def __init__(self, raw: list[bytes]):
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = raw

    def fits(self, found: np.ndarray, data: np.ndarray) -> bool:
        """Whether the ids' bytes are these. Ids without bytes, such as special ones, never fit."""
        size = self.sizes[found]
        if size.sum() != len(data) or not size.all():
            return False
        return bool((self.data[np.repeat(self.starts[found] - (np.cumsum(size) - size), size) + np.arange(len(data))] == data).all())


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: visible Latin-1 characters stand for themselves, the others for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, by the paths of their files."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        special, byte = set(self.a.get_added_tokens_decoder()), _byte_of()
        of_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            if i not in special:
                of_a[i] = bytes(byte[c] for c in token)
        of_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                of_b.append(bytes([int(piece[3:5], 16)]))
            else:
                of_b.append(b"" if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i) else piece.replace(BLANK, " ").encode())
                if BLANK in piece.lstrip(BLANK):
                    raise ValueError("the vocabulary has pieces that go on after a blank")
        self.side_a, self.side_b = Side(of_a), Side(of_b)
        # The same vocabulary by its ranks, which are its ids, in a library that is several times faster.
        self.fast_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in enumerate(of_a) if x}, special_tokens={})
        # Each id's digits with each separator behind them; entry 3 * id + separator.
        self.digits = [f"{i}{x}".encode() for i in range(max(len(of_a), len(of_b))) for x in ",|;"]

    def ids_a(self, text: str) -> np.ndarray:
        return self.fast_a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def ids_b(self, text: str) -> np.ndarray:
        """B adds the blank that the text begins with, but to an empty text it adds none."""
        return np.array(self.b.encode(text[1:], num_threads=1) if len(text) > 1 else [self.b.piece_to_id(BLANK)], np.int64)


def encode(side: Side, ids_of: Callable[[str], np.ndarray], data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all stretches end to end, their number in each, and whether their bytes are the stretch's.

    Stretches that end with a visible character are encoded together with what follows. Where the bytes of a run of stretches aren't those
    of its tokens, each stretch is encoded by itself.
    """
    sizes = np.diff(ends, prepend=0)
    fixed = np.flatnonzero(~_after_visible(data, ends)) + 1
    cuts = np.unique(np.concatenate(([0], fixed, np.searchsorted(ends, np.arange(TOGETHER, len(data), TOGETHER)), [len(ends)])))
    found, counts, sound = [np.zeros(0, np.int64)], np.zeros(len(ends), np.int64), np.ones(len(ends), bool)
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        begin, end = int(ends[i] - sizes[i]), int(ends[j - 1])
        own = ids_of(data[begin:end].tobytes().decode())
        if side.fits(own, data[begin:end]):
            at = np.searchsorted(ends[i:j], begin + np.cumsum(side.sizes[own]))
            counts[i:j] = np.bincount(at, minlength=j - i)
            found.append(own)
            continue
        for k in range(i, j):
            part = data[ends[k] - sizes[k] : ends[k]]
            own = ids_of(part.tobytes().decode())
            counts[k], sound[k] = len(own), side.fits(own, part)
            found.append(own)
    return np.concatenate(found), counts, sound


@lru_cache(maxsize=2)
def pair(a: str, b: str) -> Pair:
    return Pair(_path(a), _path(b))


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def most_pairs(a: str, b: str) -> int:
    """How many id pairs can ever end together: those where one's bytes are a suffix of the other's."""
    own = [Counter(x for x in side.raw if x) for side in (pair(a, b).side_a, pair(a, b).side_b)]
    tails = [Counter() for _ in own]
    for of, tail in zip(own, tails, strict=True):
        for x, k in of.items():
            for i in range(len(x)):
                tail[x[i:]] += k
    return sum(k * (tails[1][x] - own[1][x]) for x, k in own[0].items()) + sum(k * tails[0][x] for x, k in own[1].items())


def _after_visible(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is surely no white space; a few visible ones count as white, too, which only makes stretches longer."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = (one >= 0x80) & (((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A))))
    return (one > 0x20) & (one != 0x7F) & ~wide


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct stretches of space + text of every text that isn't empty, which one each stretch in turn is, and the offsets of each text's."""
    filled = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][filled], 0x20)
    offsets = offsets + np.concatenate(([0], np.cumsum(filled)))
    at = np.flatnonzero(data == 0x20)
    first = np.zeros(len(data), bool)
    first[at[_after_visible(data, at)]] = True
    first[offsets[:-1][filled]] = True
    starts = np.flatnonzero(first)
    cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
    found = cells.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(), np.searchsorted(starts, offsets)


class Aligned:
    """Distinct stretches of a part of the text: tokens, groups and links of each."""

    def __init__(self, p: Pair, found: list[bytes]):
        data, ends = np.frombuffer(b"".join(found), np.uint8), np.cumsum(np.array([len(x) for x in found], np.int64))
        a, n_a, sound_a = encode(p.side_a, p.ids_a, data, ends)
        b, n_b, sound_b = encode(p.side_b, p.ids_b, data, ends)
        self.sound = sound_a & sound_b
        self.n_a, self.n_b, every = n_a, n_b, np.arange(len(found))
        in_a, in_b = np.repeat(every, n_a), np.repeat(every, n_b)
        keep = self.sound[in_a]
        a, in_a = a[keep], in_a[keep]
        b = b[self.sound[in_b]]
        end_a, end_b = np.cumsum(p.side_a.sizes[a]), np.cumsum(p.side_b.sizes[b])
        both, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        self.pairs, self.owner = b[last_b] << 32 | a[last_a], in_a[last_a]
        self.links = np.bincount(self.owner, minlength=len(found))
        self.groups = lambda: self._groups(p, a, b, np.searchsorted(both, end_a), np.searchsorted(both, end_b), last_a, last_b, np.where(self.sound, n_a + n_b, 0))

    @staticmethod
    def _groups(p: Pair, a, b, group_a, group_b, last_a, last_b, counts) -> list[bytes]:  # noqa: ANN001
        """The text of each stretch's groups, with a ; behind every group."""
        code_a, code_b = a * 3, b * 3
        code_a[last_a] += 1
        code_b[last_b] += 2
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = code_a
        code[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = code_b
        words, ends = [p.digits[i] for i in code.tolist()], np.cumsum(counts).tolist()
        return [b"".join(words[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def _parts(p: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Aligned, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, distinct stretches, which one each stretch in turn is, offsets of each text's, whether a text has tokens) of bounded parts of the text."""
    for batch in batches:
        for row, end, data, offsets in pieces(batch["text"], PIECE):
            found, which, edges = stretches(data, offsets)
            aligned = Aligned(p, found)
            odd = np.concatenate(([0], np.cumsum(~aligned.sound[which])))
            yield batch["doc_id"][row:end], aligned, which, edges, (odd[edges[1:]] == odd[edges[:-1]]) & (edges[1:] > edges[:-1])


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs, which = np.unique(np.concatenate(keys), return_inverse=True)
    return pairs, np.bincount(which, np.concatenate(counts), len(pairs)).astype(np.int64)


def _partial(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    """Step 1: how many links of the partition hold each pair."""
    keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for _, aligned, which, edges, told in _parts(pair(a, b), batches):
        times = np.bincount(which[np.repeat(told, np.diff(edges))], minlength=len(aligned.sound))[aligned.owner]
        keys.append(aligned.pairs[times > 0])
        counts.append(times[times > 0])
        held += len(keys[-1])
        if held > HELD:
            (k, c), held = _added(keys, counts), 0
            keys, counts = [k], [c]
    k, c = _added(keys, counts)
    for i in range(0, len(k), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)]), pa.array(c[i : i + (1 << 16)])], names=["pair", "count"])
    tidy()


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2: rows sorted by pair become one row a pair; a batch's last pair waits for the next batch."""
    key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key = np.concatenate((key, batch["pair"].to_numpy()))
        count = np.concatenate((count, batch["count"].to_numpy()))
        if len(key):
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            key, count = key[first], np.add.reduceat(count, first)
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1]), pa.array(count[:-1])], names=["pair", "count"])
            key, count = key[-1:], count[-1:]
    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], names=["pair", "count"])


def packed_counts(documents: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """pair (B's id << 32 | A's id) and count of the links of all documents, sorted within range partitions; texts without tokens (see `align`) have no links."""
    # Partial counts are written once, since dealing out by range reads its input twice.
    partial = cut(ids(documents, id_column, text_column).mapInArrow(lambda batches: _partial(batches, a, b), "pair long, count long"))
    return partial.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(_run_lengths, "pair long, count long")


def pair_counts(documents: DataFrame, **options: str) -> DataFrame:
    """a_id, b_id and count of all linked pairs of ids; no rows for an empty table."""
    return packed_counts(documents, **options).select(F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("a_id"), F.shiftright("pair", 32).cast("int").alias("b_id"), "count")


class Shards:
    """Sorted count shards as files that Spark brings to every executor."""

    def __init__(self, names: list[str], firsts: np.ndarray, best: str):
        self.names, self.firsts, self.best_name = names, firsts, best

    @staticmethod
    def write(counts: DataFrame, bound: int, vocabulary: int) -> Shards:
        """Step 3. The driver gets `bound` pairs at most, which the vocabularies alone decide."""
        spark = counts.sparkSession
        share(spark)
        rows = counts.toArrow().sort_by("pair")
        key, count = (rows[x].to_numpy() for x in ("pair", "count"))
        if len(key) > bound:
            raise ValueError(f"{len(key)} pairs, where the vocabularies allow {bound}")
        folder = f"{spark.sparkContext.getCheckpointDir()}/alignment-{uuid.uuid4().hex}"
        best = np.zeros(vocabulary, np.int64)
        np.maximum.at(best, key >> 32, count)

        def save(name: str, values: np.ndarray) -> str:
            held = io.BytesIO()
            np.save(held, values)
            name = f"{name}-{folder[-32:]}.npy"
            put(spark, f"{folder}/{name}", held.getvalue())
            spark.sparkContext.addFile(f"{folder}/{name}")
            return name

        edges = range(0, len(key), SHARD)
        return Shards([save(f"pairs-{i}", np.stack((key[i : i + SHARD], count[i : i + SHARD]))) for i in edges], key[edges.start : edges.stop : SHARD], save("best", best))

    def open(self) -> tuple[list[np.ndarray], np.ndarray]:
        mapped = [np.load(SparkFiles.get(x), mmap_mode="r") for x in (*self.names, self.best_name)]
        return mapped[:-1], mapped[-1]

    def counts(self, shards: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
        out, home = np.zeros(len(pairs), np.int64), np.searchsorted(self.firsts, pairs, "right") - 1
        for i, (key, count) in enumerate(shards):
            own = np.flatnonzero(home == i)
            at = np.minimum(np.searchsorted(key, pairs[own]), len(key) - 1)
            out[own] = np.where(key[at] == pairs[own], count[at], 0)
        return out


def align(documents: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is their B id's highest), count_sum (of the links' counts) and groups of every document.

    groups names the ids in order: those of A and of B with | between them, groups with ; between them. Null and empty texts have no
    tokens; nor have texts whose tokens' bytes differ from space + text, such as those with U+2581. They get zeros and ''. Rows that
    repeat count once each, as rows of their own; rows with a null id leave. An empty table gives no rows; further columns are not read.
    """
    p = pair(a, b)
    shards = Shards.write(packed_counts(documents, a, b, id_column, text_column), most_pairs(a, b), len(p.side_b.raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, best = shards.open()
        for doc, aligned, which, edges, told in _parts(pair(a, b), batches):
            count = shards.counts(opened, aligned.pairs)
            total, top = (np.zeros(len(aligned.sound), np.int64) for _ in range(2))
            np.add.at(total, aligned.owner, count)
            np.add.at(top, aligned.owner, (count == best[aligned.pairs >> 32]).astype(np.int64))

            def of_texts(x: np.ndarray, which=which, edges=edges, told=told) -> pa.Array:
                before = np.concatenate(([0], np.cumsum(x[which])))
                return pa.array(np.where(told, before[edges[1:]] - before[edges[:-1]], 0), pa.int64())

            words, turn = aligned.groups(), which.tolist()
            groups = [b"".join([words[k] for k in turn[i:j]])[:-1].decode() if ok else "" for i, j, ok in zip(edges[:-1].tolist(), edges[1:].tolist(), told.tolist(), strict=True)]
            links = of_texts(aligned.links)
            yield pa.RecordBatch.from_arrays([doc, of_texts(aligned.n_a), of_texts(aligned.n_b), links, links, of_texts(top), of_texts(total), pa.array(groups, pa.string())], names=[x.split()[0] for x in DIGEST.split(", ")])
        tidy()

    return ids(documents, id_column, text_column).mapInArrow(run, DIGEST)
