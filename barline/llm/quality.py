"""Quality scores from random-indexing word vectors and a two-layer network.

Words and runs of symbols are hashed into a fixed number of rows. Every row has a sparse random index vector of +1 and -1;
a row's word vector is its own index vector plus the mean of the index vectors of its neighbours in all documents, summed by Spark.
A token also has a shape (letters or symbols, capitals, length, same as the token before), and shapes have vectors in the
same way. A document is the mean of its words' vectors and the mean of its shapes' vectors, with its length and its share of
distinct words beside them. A network with one hidden layer, written in numpy, gives the log-odds; a temperature fitted on
rows that the network has not seen turns them into probabilities.

The network is fitted on a sample of at most `rows` labelled texts of at most `chars` characters; the table of vectors and
the network have fixed sizes, whatever the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm._sample import fitted, kept, labelled
from barline.llm._spark import ids, tidy
from barline.llm._text import hashes, lower, mix, pieces

ROWS, SHAPES, WIDTH, HIDDEN = 1 << 15, 128, 32, 24
_WORD = np.full(256, 2, np.uint8)  # 1 letters, digits and bytes of other alphabets, 2 symbols, 0 white space
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_WORD[[0x20, *range(0x09, 0x0E)]] = 0
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the text, row of the word table, shape) of each token."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    kind = _WORD[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    owner = np.searchsorted(offsets, starts, "right") - 1
    h = hashes(lower(data), starts, ends)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    capital = _CAPITAL[data]
    case = capital[starts].astype(np.int64) + (capital[starts] & capital[np.minimum(starts + 1, ends - 1)])
    size = np.minimum(7, ends - starts)
    shape = ((kind[starts].astype(np.int64) - 1) * 64 + same * 32 + np.minimum(case, 2) * 8 + size) % SHAPES
    return owner, (h % np.uint64(ROWS)).astype(np.int64), ROWS + shape


def index_vectors() -> np.ndarray:
    """Eight signs at hashed places of every row."""
    out = np.zeros((ROWS + SHAPES, WIDTH), np.float32)
    row = np.arange(ROWS + SHAPES)
    for i in range(8):
        h = mix(row.astype(np.uint64) * np.uint64(8) + np.uint64(i + 1))
        np.add.at(out, (row, (h % np.uint64(WIDTH)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def features(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), 2 * WIDTH + 2), np.float32)
        for row, end, data, offsets in pieces(column):
            owner, word, shape = tokens(data, offsets)
            if not len(owner):
                continue
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            here, count = row + owner[first], np.diff(np.append(first, len(owner)))[:, None]
            out[here, :WIDTH] = np.add.reduceat(self.vectors[word], first) / count
            out[here, WIDTH:-2] = np.add.reduceat(self.vectors[shape], first) / count
            pairs = np.unique(owner * (ROWS + SHAPES) + word) // (ROWS + SHAPES)
            out[here, -2] = np.log1p(count[:, 0])
            out[here, -1] = np.bincount(pairs, minlength=end - row)[owner[first]] / count[:, 0]
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(self.features(column)).astype(np.float64) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, epochs: int, seed: int) -> list[np.ndarray]:
    """Adam over mini-batches of the log loss, with weight decay."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            a, b, c, d = layers
            hidden = np.tanh(x[batch] @ a + b)
            off = (1 / (1 + np.exp(-np.clip(hidden @ c + d, -30, 30))) - y[batch]) / len(batch)
            back = off[:, None] * c * (1 - hidden**2)
            t += 1
            for i, g in enumerate((x[batch].T @ back + 1e-4 * a, back.sum(0), hidden.T @ off + 1e-4 * c, off.sum())):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return layers


def word_vectors(documents: DataFrame) -> np.ndarray:
    """Vectors of all table rows from every text of (doc_id, text). A task sends a row of sums for each table row that it met, so the exchange is bounded by tasks times table rows."""
    names = [f"c{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = index_vectors().astype(np.int16)  # a sum of four neighbours stays small
        around, seen = np.zeros(vectors.shape, np.int64), np.zeros(len(vectors), np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch["text"], 1 << 17):
                owner, word, shape = tokens(data, offsets)
                for table in (word, shape):
                    # The sum of a token's neighbours' vectors, then of all tokens with one table row.
                    own = vectors[table]
                    beside, count = np.zeros_like(own), np.zeros(len(own), np.int16)
                    for step in (1, 2):
                        left, right = beside[:-step], beside[step:]
                        left += own[step:]
                        right += own[:-step]
                        count[:-step] += 1
                        count[step:] += 1
                        apart = np.flatnonzero(owner[step:] != owner[:-step])  # of two texts
                        left[apart] -= own[apart + step]
                        count[apart] -= 1
                        right[apart] -= own[apart]
                        count[apart + step] -= 1
                    order = np.argsort(table.astype(np.uint16), kind="stable")
                    if len(order):
                        rows = table[order]
                        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                        around[rows[first]] += np.add.reduceat(beside[order], first, dtype=np.int32)
                        seen[rows[first]] += np.add.reduceat(count[order], first, dtype=np.int64)
        met = np.flatnonzero(seen)
        for low in range(0, len(met), 4096):
            own = met[low : low + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own]), *(pa.array(around[own, i]) for i in range(WIDTH))], names=["row", "seen", *names])
        del around, vectors
        tidy()

    sums = documents.select("text").mapInArrow(run, "row long, seen long, " + ", ".join(f"{n} long" for n in names))
    got = sums.groupBy("row").agg(*[F.sum(n).alias(n) for n in ("seen", *names)]).toArrow()
    vectors, at = index_vectors(), got["row"].to_numpy()
    vectors[at] += np.stack([got[n].to_numpy() for n in names], 1) / got["seen"].to_numpy()[:, None]
    return vectors


def fit(vectors: np.ndarray, texts: list[str], labels: np.ndarray, epochs: int = 60, seed: int = 1) -> Model:
    """A model of the labelled texts. With one class only, or none, every score is the smoothed share of label 1."""
    column = pa.array(texts, pa.string())
    model = Model(vectors, np.zeros(1), np.ones(1), [], 1.0)
    x = model.features(column)
    model.mean, model.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(2 * WIDTH + 2), np.ones(2 * WIDTH + 2))
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        model.layers = [np.zeros((2 * WIDTH + 2, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.log(share / (1 - share))]
        return model
    calibrate = np.random.default_rng(seed).random(len(x)) < 0.2
    if len(set(labels[calibrate].tolist())) < 2 or len(set(labels[~calibrate].tolist())) < 2:
        calibrate[:] = False
    z = (x - model.mean) / model.scale
    model.layers = train(z[~calibrate], labels[~calibrate], epochs, seed)
    if calibrate.any():
        odds, y = model.log_odds(x[calibrate]), labels[calibrate]
        grid = np.geomspace(0.25, 8, 41)
        model.temperature = float(grid[np.argmin([np.logaddexp(0, np.where(y == 1, -1, 1) * odds / t).mean() for t in grid])])
    return model


def learned(documents: DataFrame, labels: DataFrame, learn: Column, rows: int = 4000, chars: int = 20_000, label: str = "quality", id_column: str = "doc_id", text_column: str = "text") -> Broadcast:
    """The model of the labelled rows that `learn` allows: at most `rows` texts of at most `chars` characters. Word vectors come from all texts."""
    texts = ids(documents, id_column, text_column)
    vectors = documents.sparkSession.sparkContext.broadcast(word_vectors(texts))
    sample = labelled(texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), labels, label, learn, rows, chars)
    return documents.sparkSession.sparkContext.broadcast(fitted(sample, lambda got, marks: fit(vectors.value, got, marks)))


def score(documents: DataFrame, labels: DataFrame, learn: Column, rows: int = 4000, chars: int = 20_000, label: str = "quality", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score, the calibrated probability of label 1, for every whole text.

    `learn` says which labelled rows may be learned from. Null and empty texts have the score of a document without words.
    Repeated rows are scored each; an id with several labels counts with the larger. Rows with a null id leave. Without
    usable labels every score is 0.5. An empty table gives no rows; further columns are not read.
    """
    model = learned(documents, labels, learn, rows, chars, label, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.value.scores(batch["text"]))], names=["doc_id", "score"])

    return ids(documents, id_column, text_column).mapInArrow(run, "doc_id long, score double")


def keep(documents: DataFrame, labels: DataFrame, learn: Column, least: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, that a score of at least `least` keeps, each judged by its own text; rows without an id leave. Null texts score as empty ones."""
    model = learned(documents, labels, learn, id_column=id_column, text_column=text_column)
    return kept(documents, text_column, id_column, lambda texts: model.value.scores(texts), lambda s: s >= least)
