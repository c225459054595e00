"""Toxicity scores of text that is first restored through a noisy-channel model.

Tokens that look obfuscated become character lattices: a leet sign stands for the letters it resembles, a repeated letter
may be one or two, and separators between single letters may be nothing. Viterbi search over pairs of letters finds the most
likely letters under a character trigram model, counted over every text of the corpus by one aggregation, and the channel's
costs. Plain words have a single path and pass unchanged. Restored text is scored by words and word beginnings whose
weights come from labelled rows, combined by logistic regression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm._sample import fitted, kept, labelled
from barline.llm._spark import ids
from barline.llm._text import hashes, pieces

LETTERS = 27  # a to z, and 0 for everything else
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
#: What a sign may stand for, in the writer's mind.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "aeiou", "v": "vu"}
SIGN, SPACE, REPEAT, AS_IS = 0.7, 0.1, 0.3, 3.0  # costs, in nats, of a sign, a dropped separator, a dropped repeat, a letter's rarer reading
_SIGNS = "0-9@$!|+(€*#"
_TOKEN = re.compile(
    rf"(?<!\w)(?:[^\W_]|[@$!|+€])(?:([ .\-_*])(?:[^\W_]|[@$!|+€])(?![^\W_]))(?:\1(?:[^\W_]|[@$!|+€])(?![^\W_]))+"  # s p a c e d
    rf"|(?:[^\W_]|[{_SIGNS}])+"  # l33t, looong
)
CLOSING = {"!": 0.1, "|": 3.0, "$": 4.0}  # nats of a sign after a word that stands for no letter
_IS_SPACE, _IS_LETTER, _IS_SIGN, _IS_ENDING, _IS_GAP = (np.isin(np.arange(256), [*x]) for x in ([0x20, *range(0x09, 0x0E)], [*range(97, 123), *range(128, 256)], b"0123456789@$!|+(*#", b"0123456789@$!|", b" .-_*"))


def suspects(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of lower-case text, whole tokens between white space, that may be obfuscated."""
    edge = np.concatenate(([32, 32, 32], data, [32, 32, 32])).astype(np.uint8)
    at = lambda table, i: table[edge[3 + i : 3 + i + len(data)]]
    same = lambda i: edge[3 + i : 3 + i + len(data)] == data
    letter = at(_IS_LETTER, 0)
    sign = at(_IS_SIGN, 0) & (at(_IS_LETTER, 1) | at(_IS_LETTER, -1) & _IS_ENDING[data])
    repeat = letter & same(1) & same(2) & (data < 128)
    single = (letter | at(_IS_SIGN, 0)) & at(_IS_GAP, 1) & at(_IS_GAP, -1)
    spaced = (single | (letter & at(_IS_GAP, 1) & at(_IS_SPACE, -1))) & (edge[5 : 5 + len(data)] != 32) & (letter | at(_IS_LETTER, 2) | at(_IS_LETTER, -2)) & ~at(_IS_GAP, 2) & (at(_IS_GAP, 3) | ~at(_IS_LETTER, 3)) | letter & at(_IS_GAP, -1) & ~at(_IS_GAP, -2) & at(_IS_GAP, -3) & ~at(_IS_LETTER, 1)
    hits = np.flatnonzero(sign | repeat | spaced)
    if not len(hits):
        return hits, hits
    cuts = np.union1d(np.flatnonzero(at(_IS_SPACE, 0)) + 1, offsets)
    token = np.unique(np.searchsorted(cuts, hits, "right") - 1)
    starts, ends = cuts[token], np.append(cuts, len(data))[token + 1]
    joined = (starts[1:] == ends[:-1]) & ~np.isin(starts[1:], offsets)
    return starts[np.concatenate(([True], ~joined))], ends[np.concatenate((~joined, [True]))]


def trigram_counts(documents: DataFrame) -> np.ndarray:
    """Counts of letter triples over all texts of (doc_id, text): at most 27**3 rows from each task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for _, _, data, _ in pieces(batch["text"]):
                c = np.concatenate(([0, 0], _CLASS[data], [0]))
                total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=LETTERS**3)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    got = documents.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LETTERS**3)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(LETTERS, LETTERS, LETTERS)


@dataclass
class Restorer:
    """Viterbi decoding of obfuscated tokens."""

    cost: np.ndarray  # nats of the third letter after the first two
    kept: dict[bytes, bytes] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: np.ndarray) -> Restorer:
        pair, single = counts.sum(0), counts.sum((0, 1))
        one = (single + 1) / (single.sum() + LETTERS)
        two = (pair + 20 * one) / (pair.sum(1, keepdims=True) + 20)
        three = (counts + 20 * two[None]) / (counts.sum(2, keepdims=True) + 20)
        return cls(-np.log(three))

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each character, its readings (letters or nothing) and their costs."""
        spaced = len(token) > 4 and all(c in " .-_*" for c in token[1::2])
        out, run = [], 0
        for i, c in enumerate(token):
            run = run + 1 if i and c == token[i - 1] else 0
            if spaced and i % 2:
                out.append([("", SPACE)])
                continue
            reads = [(x, SIGN if c != "v" else AS_IS if x != "v" else 0.0) for x in LEET[c]] if c in LEET else [(c, 0.0)]
            if c.isalpha() and c.isascii() and run:
                twice = run == 1 and token[i + 1 : i + 2] != c  # a plain double letter is rarely a repetition
                reads = [("", AS_IS if twice else REPEAT)] + ([(c, 0.0)] if run == 1 else [])
            elif run and c in LEET and not c.isalpha():
                reads = [*reads, ("", REPEAT)]
            out.append(reads)
        return out

    def decode(self, token: str) -> str:
        """The cheapest reading, in lower case. Signs at the ends that stand for no letter of a word are left out first."""
        return self.cheapest(self.lattice(token))[1]

    def cheapest(self, lattice: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """Cost and letters of the cheapest path. Paths share their beginnings, so the time is linear in the length."""
        state: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for reads in lattice:
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, text) in state.items():
                for letter, extra in reads:
                    c = ord(letter) - 96 if letter and "a" <= letter <= "z" else 0
                    key, total = ((a, b), cost + extra) if not letter else ((b, c), cost + extra + self.cost[a, b, c])
                    if key not in after or total < after[key][0]:
                        after[key] = total, (text, letter) if letter else text
            state = after

        def spelled(path: tuple) -> str:
            letters = []
            while path:
                path, letter = path
                letters.append(letter)
            return "".join(reversed(letters))

        return min((cost + self.cost[a, b, 0], spelled(path)) for (a, b), (cost, path) in state.items())

    def _replace(self, match: re.Match) -> str:
        token = match[0]
        core = token if match[1] else token.rstrip("!*|+(#$").lstrip("*|+(#")
        signs = sum(not c.isalpha() for c in core)
        plain = len(core) < 3 or not match[1] and (not signs and not re.search(r"(.)\1\1", core) or signs > 0.8 * len(core))
        closing = "" if match[1] or signs == len(core) else re.match("[$!|]*", token.lstrip("*|+(#")[len(core) :])[0]
        if not closing or len(core) + len(closing) < 3:
            return token if plain else self.decode(core)
        # With the closing signs as letters, or without them; a plain word's own letters are not in doubt.
        word = [[(c, 0.0)] for c in core] if plain else self.lattice(core)
        without, left = self.cheapest(word)
        letters, read = self.cheapest([*word, *([(x, SIGN) for x in LEET[c]] for c in closing)])
        if letters < without + sum(CLOSING[c] for c in closing):
            return read
        return token if plain else left

    def restore(self, column: pa.Array) -> pa.Array:
        """Whole texts in lower case, obfuscated tokens restored; null counts as empty."""
        out: list[bytes] = []
        for _, _, data, offsets in pieces(pc.utf8_lower(column)):
            raw = data.tobytes()
            starts, ends = suspects(data, offsets)
            owner = np.searchsorted(offsets, starts, "right") - 1
            groups = np.searchsorted(owner, np.arange(len(offsets)))
            for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if groups[row] == groups[row + 1]:
                    out.append(raw[lo:hi])
                    continue
                parts, done = [], lo
                for i in range(groups[row], groups[row + 1]):
                    stretch = raw[starts[i] : ends[i]]
                    new = self.kept.get(stretch)
                    if new is None:
                        if len(self.kept) > 50_000:
                            self.kept.clear()
                        new = self.kept[stretch] = _TOKEN.sub(self._replace, stretch.decode()).encode()
                    parts += [raw[done : starts[i]], new]
                    done = ends[i]
                out.append(b"".join([*parts, raw[done:hi]]))
        return pa.array(out, pa.large_binary())


BUCKETS, BEGINNINGS = 1 << 18, (0, 4, 5, 6, 7, 8)  # hashed features; bytes of a word's beginning, 0 for the word
_INNER = np.zeros(256, bool)
_INNER[[*range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and each word beginning; words are runs of letters."""
    inside = _INNER[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))[: len(data)]))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False]))[: len(data)])) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    rows, buckets = [], []
    for length in BEGINNINGS:
        which = slice(None) if not length else np.flatnonzero(ends - starts >= length)
        s, e = starts[which], ends[which]
        h = hashes(data, s, s + length if length else e) + np.uint64(length * 0x9E3779B1)
        rows.append(owner[which])
        buckets.append((h % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


@dataclass
class Model:
    restorer: Restorer
    weights: np.ndarray  # of each bucket; 0 where the labels say nothing
    beta: np.ndarray

    def summary(self, texts: pa.Array) -> np.ndarray:
        """Of each text: 1, the largest weight, the sum of its three largest, and of all, damped, and the number of features, damped."""
        restored = self.restorer.restore(texts)
        out = np.zeros((len(texts), 5))
        out[:, 0] = 1
        for row, _, data, offsets in pieces(restored):
            owner, bucket = features(data, offsets)
            out[row : row + len(offsets) - 1, 4] = np.log1p(np.bincount(owner, minlength=len(offsets) - 1))
            told = np.flatnonzero(self.weights[bucket])
            pairs = np.unique(owner[told] * BUCKETS + bucket[told])
            owner, weight = pairs // BUCKETS, self.weights[pairs % BUCKETS]
            order = np.lexsort((-weight, owner))
            owner, weight = owner[order], weight[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            out[row + owner[place == 0], 1] = np.maximum(0, weight[place == 0])
            for column, which in ((2, place < 3), (3, place >= 0)):
                np.add.at(out[:, column], row + owner[which], np.maximum(0, weight[which]))
        out[:, 3] = np.log1p(out[:, 3])
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(texts) @ self.beta, -30, 30)))


def fit(restorer: Restorer, texts: list[str], labels: np.ndarray, strength: float = 3.0) -> Model:
    """Weights and regression of the labelled texts. With one class only, or none, the score is the smoothed share of label 1."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(restorer, np.zeros(BUCKETS), np.array([np.log(share / (1 - share)), 0, 0, 0, 0]))
    if len(set(labels.tolist())) < 2:
        return model
    column = pa.array(texts, pa.string())
    seen = []  # small parts, so that the task never holds one wide array of all features
    for row, _, data, offsets in pieces(restorer.restore(column)):
        owner, bucket = features(data, offsets)
        pairs = np.unique(owner * BUCKETS + bucket)
        seen.append(((row + pairs // BUCKETS).astype(np.int32), (pairs % BUCKETS).astype(np.int32)))
    part = np.arange(len(labels)) % 2  # weights from one half are judged on the other, so that the regression sees honest ones

    def weigh(which: np.ndarray) -> np.ndarray:
        n1, n0 = labels[which].sum(), (1 - labels[which]).sum()
        toxic, other = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for owner, bucket in seen:
            here = which[owner]
            marked = labels[owner[here]] == 1
            toxic += np.bincount(bucket[here][marked], minlength=BUCKETS)
            other += np.bincount(bucket[here][~marked], minlength=BUCKETS)
        odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((other + 0.5) / (n0 + 1))
        sure = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))  # in standard errors
        return np.where((sure > strength) & (odds > 1), odds, 0.0)

    x = np.zeros((len(labels), 5))
    for half in (0, 1):
        model.weights = weigh(part != half)
        mine = np.flatnonzero(part == half)
        x[mine] = model.summary(column.take(pa.array(mine)))
    model.weights = weigh(np.ones(len(labels), bool))
    beta = model.beta.copy()
    for _ in range(50):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(5), x.T @ (p - labels) + 0.5 * beta)
    model.beta = beta
    restorer.kept.clear()  # tasks keep their own
    return model


def learned(documents: DataFrame, labels: DataFrame, learn: Column, rows: int = 6000, chars: int = 20_000, label: str = "toxic", id_column: str = "doc_id", text_column: str = "text") -> Broadcast:
    """The model of the labelled rows that `learn` allows: at most `rows` texts of at most `chars` characters."""
    texts = ids(documents, id_column, text_column)
    restorer = Restorer.of(trigram_counts(texts))
    sample = labelled(texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), labels, label, learn, rows, chars)
    return documents.sparkSession.sparkContext.broadcast(fitted(sample, lambda got, marks: fit(restorer, got, marks)))


def score(documents: DataFrame, labels: DataFrame, learn: Column, rows: int = 6000, chars: int = 20_000, label: str = "toxic", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score, the probability of label 1 of every whole restored text.

    The letter model counts all documents. `learn` says which labelled rows may be learned from: at most `rows` texts of at
    most `chars` characters. Null and empty texts score as a text without words. Repeated rows are scored each; an id with several
    labels counts with the larger. Rows with a null id leave. Without usable labels every score is 0.5. An empty table
    gives no rows; further columns are not read.
    """
    model = learned(documents, labels, learn, rows, chars, label, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.value.scores(batch["text"]))], names=["doc_id", "score"])

    return ids(documents, id_column, text_column).mapInArrow(run, "doc_id long, score double")


def keep(documents: DataFrame, labels: DataFrame, learn: Column, below: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, that a score below `below` keeps, each judged by its own text; rows without an id leave. Null texts score as empty ones."""
    model = learned(documents, labels, learn, id_column=id_column, text_column=text_column)
    return kept(documents, text_column, id_column, lambda texts: model.value.scores(texts), lambda s: s < below)
