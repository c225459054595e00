"""Quality rules as a short-circuit cascade.

A rule rejects a text by integer comparisons of features. On a sample, the cost of each feature (CPU time a text) and what each
rule rejects are measured; then the rules are ordered: always the one next that rejects most of what is still there, for each
unit of what it costs beyond the features that earlier rules have paid for. A text leaves at its first rejection, and features that only
later rules need are not computed for it. The order decides the work and which rule is named, not the verdict.

Words are `[^\\x20\\x09-\\x0D]+`. All comparisons of words and lines are by their bytes: hashes only preselect windows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm._repeats import ragged
from barline.llm._spark import ids, tidy
from barline.llm._text import hashes, mix, pieces, runs, words

PIECE = 1 << 21  # bytes of text that are worked on at once
WINDOW = 8  # words of a window that may repeat
SAMPLE_ROWS, SAMPLE_CHARS = 512, 20_000  # the sample that costs are measured on
_SYMBOL, _LETTER, _CAPITAL = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[[*b"#*$%&|<>"]] = True
_CAPITAL[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Texts:
    """Texts laid end to end, and what several features share."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def only(self, rows: np.ndarray) -> Texts:
        starts, sizes = self.offsets[:-1][rows], np.diff(self.offsets)[rows]
        return Texts(self.data[ragged(starts, sizes)], np.concatenate(([0], np.cumsum(sizes))))

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return words(self.data, self.offsets)

    def sums(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        before = np.concatenate(([0], np.cumsum(marked)))
        return before[self.offsets[1:]] - before[self.offsets[:-1]]


def n_words(t: Texts) -> np.ndarray:
    return np.bincount(t.words[2], minlength=t.n)


def word_chars(t: Texts) -> np.ndarray:
    """Code points in words: bytes that begin a character."""
    starts, ends, _ = t.words
    inside = np.zeros(len(t.data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    return t.sums((np.cumsum(inside[:-1], dtype=np.int8) > 0) & (t.data & 0xC0 != 0x80))


def n_symbols(t: Texts) -> np.ndarray:
    return t.sums(_SYMBOL[t.data])


def n_capitals(t: Texts) -> np.ndarray:
    return t.sums(_CAPITAL[t.data])


def n_letters(t: Texts) -> np.ndarray:
    return t.sums(_LETTER[t.data])


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, equal for equal bytes."""
    sizes = ends - starts
    cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)), pa.py_buffer(data[ragged(starts, sizes)])])
    return cells.dictionary_encode().indices.to_numpy().astype(np.int64)


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text of the lines that have a word."""
    breaks = np.flatnonzero(t.data == 0x0A)
    starts = np.unique(np.concatenate((t.offsets[:-1][np.diff(t.offsets) > 0], breaks + 1)))
    starts = starts[starts < len(t.data)]
    row = np.searchsorted(t.offsets, starts, "right") - 1
    after = np.append(breaks, len(t.data))
    ends = np.minimum(after[np.searchsorted(after, starts)], t.offsets[row + 1])
    told = np.searchsorted(t.words[0], starts) < np.searchsorted(t.words[0], ends)
    return starts[told], ends[told], row[told]


def n_lines(t: Texts) -> np.ndarray:
    """Lines with a word."""
    return np.bincount(_lines(t)[2], minlength=t.n)


def n_dup_lines(t: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    starts, ends, row = _lines(t)
    distinct = np.unique(row << 32 | _numbers(t.data, starts, ends)) >> 32
    return np.bincount(row, minlength=t.n) - np.bincount(distinct, minlength=t.n)


def n_echoes(t: Texts) -> np.ndarray:
    """Words that equal the word before."""
    starts, ends, row = t.words
    near = np.flatnonzero((row[1:] == row[:-1]) & (np.diff(ends) - np.diff(starts) == 0)) + 1  # of equal length
    number = _numbers(t.data, np.concatenate((starts[near - 1], starts[near])), np.concatenate((ends[near - 1], ends[near])))
    return np.bincount(row[near[number[: len(near)] == number[len(near) :]]], minlength=t.n)


def n_repeat_words(t: Texts, window: int = WINDOW) -> np.ndarray:
    """Words in windows that the text has twice or more, the first of them included."""
    starts, ends, row = t.words
    n = max(len(starts) - window + 1, 0)
    at = np.flatnonzero(row[:n] == row[window - 1 :]) if n else np.zeros(0, np.int64)
    h = mix(runs(hashes(t.data, starts, ends), window)[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if n else np.zeros(0, np.uint64)
    order = np.sort(h)
    at = at[np.isin(h, order[1:][order[1:] == order[:-1]])]
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(at):
        # Those that may repeat are told apart by their words.
        used = np.unique((at[:, None] + np.arange(window)).ravel())
        number = np.zeros(len(starts), np.int64)
        number[used] = _numbers(t.data, starts[used], ends[used])
        key = row[at] << 32
        for k in range(window):
            _, name = np.unique(number[at + k], return_inverse=True)
            _, key = np.unique((key if not k else key << 32) | name, return_inverse=True)
        at = at[np.bincount(key)[key] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    return np.bincount(row[np.cumsum(covered[:-1]) > 0], minlength=t.n)


FEATURES: dict[str, Callable[[Texts], np.ndarray]] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_capitals, n_letters, n_lines, n_dup_lines, n_echoes, n_repeat_words)}


@dataclass(frozen=True)
class Rule:
    """Rejects texts for which `rejects` of the named features is true."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray] = field(compare=False)


#: Few words, and much of the text in repeated windows.
BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
)
#: Words of a mean length outside 2 to 15, a symbol for every fourth word, half of all lines repeated, half of all letters capitals, half of all words equal to the one before.
RULES = (
    *BASE,
    Rule("short_words", ("word_chars", "n_words"), lambda c, n: c < 2 * n),
    Rule("long_words", ("word_chars", "n_words"), lambda c, n: c > 15 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 4 * s > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 2 * d > n),
    Rule("capitals", ("n_capitals", "n_letters"), lambda c, n: 2 * c > n),
    Rule("echoes", ("n_echoes", "n_words"), lambda e, n: 2 * e > n),
)


def order(rules: tuple[Rule, ...], rejected: dict[str, np.ndarray], costs: dict[str, float]) -> list[Rule]:
    """The rules by what they reject of the sample's remaining rows for each unit of cost; rules that reject none of them last, the cheapest first.

    `rejected` says by rule which rows of the sample it rejects, `costs` by feature what a row costs. What a rule's features cost counts
    once; ties go by the rules' own order.
    """
    left, paid, out = list(rules), set(), []
    alive = np.ones(len(next(iter(rejected.values()), [])), bool)
    while left:
        price = [sum(costs[f] for f in set(r.needs) - paid) + 1e-9 for r in left]
        gain = [np.count_nonzero(rejected[r.name] & alive) for r in left]
        best = max(range(len(left)), key=lambda i: (gain[i] / price[i], -price[i], -i))
        rule = left.pop(best)
        out.append(rule)
        paid |= set(rule.needs)
        alive &= ~rejected[rule.name]
    return out


def measured(texts: list[str], rules: tuple[Rule, ...], free: tuple[str, ...] = (), times: int = 3) -> list[Rule]:
    """The order of the rules by costs measured on these texts, at best of `times`; features in `free` cost nothing, since all texts have them anyway."""
    raw = [(t or "").encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    values, costs = {}, {}
    for name in dict.fromkeys(f for r in rules for f in r.needs):
        took = []
        for _ in range(times):
            t = Texts(data, offsets)
            began = time.thread_time_ns()
            values[name] = FEATURES[name](t)
            took.append(time.thread_time_ns() - began)
        costs[name] = 0.0 if name in free else min(took) / max(len(raw), 1)
    return order(rules, {r.name: r.rejects(*[values[f] for f in r.needs]) for r in rules}, costs)


def planned(rows: DataFrame, rules: tuple[Rule, ...], free: tuple[str, ...] = (), sample: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[Rule]:
    """`measured` on the `sample` rows whose ids hash lowest, without texts of more than `chars` characters, in one task. Ids are chosen before texts are moved."""
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = rows.where(F.length("text") <= chars).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    by_name = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for b in batches for x in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([[r.name for r in measured(found, rules, free)]], pa.list_(pa.string()))], names=["names"])

    got = texts.repartition(1).mapInArrow(run, "names array<string>").collect()
    return [by_name[x] for x in got[0]["names"]] if got else list(rules)


def judged(t: Texts, rules: list[Rule], report: tuple[str, ...] = ()) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, int]]:
    """Which rule rejects each text (an index, or -1), the reported features of all texts, and how many texts each feature was computed for."""
    known = {f: FEATURES[f](t) for f in report}
    told, work = {f: v for f, v in known.items()}, dict.fromkeys(report, t.n)
    by, alive = np.full(t.n, -1), np.arange(t.n)
    for i, rule in enumerate(rules):
        if not len(alive):
            break
        for f in rule.needs:
            if f not in known:
                known[f] = FEATURES[f](t)
                work[f] = t.n
        out = rule.rejects(*[known[f] for f in rule.needs])
        if out.any():
            by[alive[out]] = i
            alive, known = alive[~out], {f: v[~out] for f, v in known.items()}
            if any(f not in known for r in rules[i + 1 :] for f in r.needs):
                t = t.only(np.flatnonzero(~out))
    return by, told, work


def cascade(documents: DataFrame, rules: tuple[Rule, ...] = RULES, report: tuple[str, ...] = (), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, kept, rejected_by (the rule that came first; null for kept ones) and the features in `report`, which are computed for every text.

    Null texts count as empty ones, which have no words. Repeated rows are judged alike; rows with a null id leave. An empty table gives no
    rows; further columns are not read.
    """
    rows = ids(documents, id_column, text_column)
    ordered = planned(rows, rules, report)
    names = pa.array([r.name for r in ordered], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in pieces(batch["text"], PIECE):
                by, told, _ = judged(Texts(data, offsets), ordered, report)
                why = names.take(pa.array(by, mask=by < 0))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][row:end], pa.array(by < 0), why, *[pa.array(told[f], pa.int64()) for f in report]], names=["doc_id", "kept", "rejected_by", *report])
        tidy()

    return rows.mapInArrow(run, ", ".join(["doc_id long, kept boolean, rejected_by string", *[f"{f} long" for f in report]]))


def keep(documents: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns, each by its own text, in the task that reads it. Rows without an id leave; null texts count as empty."""
    ordered = planned(ids(documents, id_column, text_column), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [judged(Texts(data, offsets), ordered)[0] < 0 for _, _, data, offsets in pieces(batch[text_column], PIECE)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))
        tidy()

    return documents.where(F.col(id_column).isNotNull()).mapInArrow(run, documents.schema)
