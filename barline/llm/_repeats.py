"""Exact removal of repeated stretches: the exchange that the suffix-array and the factoring operator share.

A window is `length` consecutive symbols (bytes or words) of a text. It is repeated if the same symbols also start earlier:
in a document with a smaller id, or in the same document at a smaller place. Every symbol that a repeated window covers goes.

Equal windows have to meet without shipping every window. Each window is owned by the smallest hash of a `gram` inside it, its
anchor, which depends on the window's content alone. Neighbouring windows with one anchor are a segment, so a text gives
about two segments for every `length - gram + 1` symbols, and equal windows always lie in segments of equal anchors.

1. Segments, without their symbols, are dealt out by anchor; hashes of their content only route. Of segments with one hash all
   but the first are suspected copies of the first, and keep its place. Anchors that occur once leave. Suspected copies of one task are
   told apart before they are sent, so a hot anchor brings one segment for each task and content.
2. First segments whose anchor has other, different segments get their symbols, in the task that holds their text, and are
   dealt out by anchor. The operator's own method compares them and finds which windows have an earlier equal. Where
   an anchor has very many different segments (the edge of a passage that much of the corpus shares), its windows are dealt
   out one by one, by two hashes of their own, which again only make them suspected copies, so that no task gathers the group.
3. Neighbouring suspected copies with one source are a stretch. The stretches of all sources that a bucket of documents needs are asked for, once each,
   and sent there. The operator's method compares each stretch with its source, symbol by symbol; what it doesn't confirm stays.
4. The repeated windows go to their texts, which lose the symbols they cover.

Bytes are compared as they are. Words are compared as words in step 3, and as 64-bit hashes of words in step 2.

Arrays travel packed, one row for each pair of task and bucket. Buckets hold a bounded number of bytes of text, so their number
grows with the corpus and the memory of a task doesn't.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm._spark import cut, ids, tidied, tidy
from barline.llm._text import hashes, inverse_powers, mix, pieces, powers, runs, words

BUCKET_BYTES, LEAST_BUCKETS = 1 << 22, 128  # bytes of text behind a bucket; fewest buckets
HOT = 512  # different segments of one anchor beyond which its windows are dealt out one by one
SELF = 1 << 20  # added to a segment's number of windows if its anchor occurs in it more than once
PART = 1 << 18  # bytes of stretches that are compared with their sources at a time
HELD = 1 << 19  # segments that a task holds before it sends them
_TOP = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F)
_KINDS = {"doc": np.int64, "tie": np.int32, "start": np.int64, "n": np.int32, "anchor": np.uint64, "content": np.uint64, "of_doc": np.int64, "of_tie": np.int32, "of_start": np.int64}
REPEATED, COMPARE, SPREAD, COPY, SOURCE = range(5)  # windows for sure; to be compared; hashes of windows; suspected copies; symbols of a source
_PLACE = ("doc", "tie", "start", "n")
_OF = ("of_doc", "of_tie", "of_start")
_SEGMENT = (*_PLACE, "anchor", "content")
_PACKED = ", ".join(f"{x} binary" for x in _KINDS)


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(x.astype(np.uint64)) >> np.uint64(20)).astype(np.int64) % buckets


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i] - 1 of every i, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def packed(bucket: np.ndarray, columns: dict[str, np.ndarray], kind: int) -> pa.RecordBatch:
    """One row for each bucket, with each column's values of that bucket as bytes; columns that aren't given are empty."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0))) if len(order) else order
    ends = np.append(edges[1:], len(order))
    arrays = [pa.array(bucket[order][edges], pa.int64()), pa.array([kind] * len(edges), pa.int32())]
    for name in _KINDS:
        values = columns[name][order] if name in columns else None
        arrays.append(pa.array([b"" if values is None else values[a:b].tobytes() for a, b in zip(edges, ends, strict=False)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "kind", *_KINDS])


def unpacked(table: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    return {x: np.frombuffer(b"".join(table[x].to_pylist()), _KINDS[x]) for x in names}


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    blocks = np.concatenate((h, np.full(-len(h) % w, _TOP, np.uint64))).reshape(-1, w)
    before = np.minimum.accumulate(blocks, 1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(h) - w + 1
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def prefix(symbols: np.ndarray, base: int) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(len(symbols), base))))


def span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return mix((total[ends] - total[starts]) * inverse_powers(len(total), base)[starts] + (ends - starts).astype(np.uint64))


def window_hashes(symbols: np.ndarray, begin: np.ndarray, n: np.ndarray, length: int) -> list[np.ndarray]:
    """Two hashes of each of the n[i] windows from begin[i] on, of every i, end to end. Works on a part at a time, so that memory stays small."""
    size = n - 1 + length
    found: list[list[np.ndarray]] = [[] for _ in _BASES]
    for own in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(size) >> 18)) + 1):
        taken, at = symbols[ragged(begin[own], size[own])], ragged(np.cumsum(size[own]) - size[own], n[own])
        for out, base in zip(found, _BASES, strict=True):
            out.append(span_hash(prefix(taken, base), at, at + length, base))
    return [np.concatenate(f) for f in found]


def segments(symbols: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """row, start (in the row), n (windows; with SELF added if some may be equal to each other), anchor and content hash of every segment of texts laid end to end."""
    w = length - gram + 1
    if len(symbols) < length:
        return {x: np.zeros(0, t) for x, t in (("row", np.int64), ("start", np.int64), ("n", np.int64), ("anchor", np.uint64), ("content", np.uint64))}
    h = runs(symbols.astype(np.uint64) + np.uint64(1), gram)
    least = sliding_min(h, w)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    inside = np.flatnonzero(np.arange(len(least)) + length <= offsets[1:][row])
    if not len(inside):
        return segments(symbols[:0], offsets, length, gram)
    own = least[inside]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (np.diff(inside) != 1) | (row[inside][1:] != row[inside][:-1])))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(inside)))
    most = min(w, SELF - 1)  # text that repeats itself may keep an anchor for long
    parts = -(-size // most)
    at = np.repeat(first, parts) + most * ragged(np.zeros(len(first), np.int64), parts)
    size = np.minimum(most, np.repeat(first + size, parts) - at)
    s = inside[at]
    # Places that are the least of some window; two neighbours of them with one hash mean a text that repeats itself there.
    far = np.full(w - 1, _TOP, np.uint64)
    minima = np.flatnonzero(~sliding_min(np.concatenate((far, ~least, far)), w) == h)
    pair = minima[:-1][(h[minima[1:]] == h[minima[:-1]]) & (np.diff(minima) < w)]
    self = np.searchsorted(pair, s) < np.searchsorted(pair, s + size + w - 1)
    total = prefix(symbols, _BASES[1])
    return {"row": row[s], "start": s - offsets[row[s]], "n": size + SELF * self, "anchor": own[at], "content": span_hash(total, s, s + size - 1 + length, _BASES[1])}


def symbols_of(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    if unit == "bytes":
        return data, offsets
    starts, ends, owner = words(data, offsets)
    return hashes(data, starts, ends), np.searchsorted(owner, np.arange(len(offsets)))


def _send(batches: Iterator[pa.RecordBatch], buckets: int, unit: str, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Step 1, in the task that reads the texts: segments by anchor, those with the hash of an earlier one of this task as its copies."""
    held: list[dict[str, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        all_ = {x: np.concatenate([h[x] for h in held]) for x in _SEGMENT}
        held.clear()
        if not len(all_["doc"]):  # texts without a whole window
            return
        order = np.lexsort((all_["start"], all_["doc"], all_["content"], all_["anchor"]))
        all_ = {x: v[order] for x, v in all_.items()}
        same = np.concatenate(([False], (all_["content"][1:] == all_["content"][:-1]) & (all_["anchor"][1:] == all_["anchor"][:-1])))
        # Rows that repeat an id start at equal places: neither is earlier.
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        same &= (all_["doc"] != all_["doc"][lead]) | (all_["start"] != all_["start"][lead])
        all_ |= {f"of_{x}": all_[x][lead] for x in ("doc", "tie", "start")}
        for copied, kind in ((same, COPY), (~same, COMPARE)):
            part = {x: v[copied] for x, v in all_.items()}
            back = np.argsort(part["doc"], kind="stable")
            part = {x: v[back] for x, v in part.items()}
            if kind == COPY:
                part["n"] %= SELF
            yield packed(bucket_of(part["doc" if kind == COPY else "anchor"], buckets), {x: part[x] for x in ((*_PLACE, *_OF) if kind == COPY else _SEGMENT)}, kind)

    for batch in batches:
        doc, tie = (batch[x].to_numpy(zero_copy_only=False) for x in ("doc_id", "tie"))
        for row, _, data, offsets in pieces(batch["text"]):
            got = segments(*symbols_of(data, offsets, unit), length, gram)
            at = row + got.pop("row")
            held.append({x: v.astype(_KINDS[x]) for x, v in (got | {"doc": doc[at], "tie": tie[at]}).items()})
        if sum(len(h["doc"]) for h in held) > HELD:
            yield from flush()
    yield from flush()
    tidy()


@tidied
def _gather(table: pa.Table, buckets: int, hot: int) -> pa.Table:
    """Step 1, for the anchors of a bucket: suspected copies, and segments that are to be compared."""
    kind = table["kind"].to_numpy()
    out = []
    known = unpacked(table.filter(pa.array(kind == COPY)), [*_PLACE, *_OF])
    new = unpacked(table.filter(pa.array(kind == COMPARE)), list(_SEGMENT))
    order = np.lexsort((new["start"], new["doc"], new["content"], new["anchor"]))
    new = {x: v[order] for x, v in new.items()}
    n = len(order)
    if n:
        edge = np.concatenate(([True], new["anchor"][1:] != new["anchor"][:-1]))
        different = edge | np.concatenate(([True], new["content"][1:] != new["content"][:-1]))
        lead = np.maximum.accumulate(np.where(different, np.arange(n), 0))
        first = different | (new["doc"] == new["doc"][lead]) & (new["start"] == new["start"][lead])
        group = np.cumsum(edge) - 1
        kinds = np.bincount(group, different)[group]
        state = np.where(~first, COPY, np.where((kinds == 1) & (new["n"] < SELF), -1, np.where(kinds > hot, SPREAD, COMPARE)))
        new["n"] = new["n"] % SELF
        new |= {f"of_{x}": new[x][lead] for x in ("doc", "tie", "start")}
        for k in (COMPARE, SPREAD):
            part = {x: v[state == k] for x, v in new.items()}
            if len(part["doc"]):
                back = np.lexsort((part["start"], part["doc"]))
                out.append(packed(bucket_of(part["doc"], buckets)[back], {x: part[x][back] for x in (*_PLACE, "anchor")}, k))
        known = {x: np.concatenate((v, new[x][state == COPY])) for x, v in known.items()}
    if len(known["doc"]):
        out.append(packed(bucket_of(known["doc"], buckets), known, COPY))
    return pa.Table.from_batches(out, _SENT)


_SENT = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in _KINDS)])
_SENT_SQL = f"bucket long, kind int, {_PACKED}"
_TEXTS = pa.schema([("bucket", pa.int64()), ("doc", pa.binary()), ("tie", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary()), ("n_bytes", pa.int64())])


def _texts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts by document, compressed: one row for each bucket."""
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        doc, tie = (batch[x].to_numpy(zero_copy_only=False) for x in ("doc_id", "tie"))
        for row, end, data, offsets in pieces(batch["text"], 1 << 23):
            here = bucket_of(doc[row:end], buckets)
            order = np.argsort(here, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], np.diff(here[order]) != 0)))
            rows = []
            for own in np.split(order, edges[1:]):
                raw = data[ragged(offsets[own], offsets[own + 1] - offsets[own])].tobytes()
                rows.append((here[own[0]], doc[row + own].tobytes(), tie[row + own].tobytes(), (offsets[own + 1] - offsets[own]).tobytes(), codec.compress(raw, asbytes=True), len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TEXTS.types, strict=True)], schema=_TEXTS)
    tidy()


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, tie, bytes and offsets of packed texts."""
    codec = pa.Codec("zstd")
    read = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    raw = b"".join(codec.decompress(b, n, asbytes=True) if n else b"" for b, n in zip(table["bytes"].to_pylist(), table["n_bytes"].to_pylist(), strict=True))
    return read("doc", np.int64), read("tie", np.int32), np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum(read("size", np.int64))))


def _rows_of(doc: np.ndarray, tie: np.ndarray, of: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index into `of`, row of the texts) of every text that an entry is about; rows that repeat a text share its entries."""
    keys, where = np.unique(np.rec.fromarrays([doc, tie]), return_inverse=True)
    entry = np.searchsorted(keys, np.rec.fromarrays([of["doc"], of["tie"]], dtype=keys.dtype))
    order = np.argsort(where, kind="stable")
    count = np.bincount(where, minlength=len(keys))
    begin = np.cumsum(count) - count
    return np.repeat(np.arange(len(entry)), count[entry]), order[ragged(begin[entry], count[entry])]


@tidied
def _compare_input(texts: pa.Table, wanted: pa.Table, buckets: int, unit: str, length: int) -> pa.Table:
    """Step 2, in the task that holds the texts: symbols of the segments that are to be compared, dealt out by anchor; windows by their hashes."""
    out: list[pa.RecordBatch] = []
    doc, tie, data, offsets = _opened(texts)
    if not len(doc):
        return _DEALT.empty_table()
    symbols, offsets = symbols_of(data, offsets, unit)
    _, one = np.unique(np.rec.fromarrays([doc, tie]), return_index=True)  # of rows that repeat a text, one is enough
    for kind in (COMPARE, SPREAD):
        got = unpacked(wanted.filter(pa.array(wanted["kind"].to_numpy() == kind)), [*_PLACE, *["anchor"] * (kind == COMPARE)])
        if not len(got["doc"]):
            continue
        entry, row = _rows_of(doc[one], tie[one], got)
        got = {x: v[entry] for x, v in got.items()}
        begin, n = offsets[one[row]] + got["start"], got["n"].astype(np.int64)
        names = {x: got[x] for x in ("doc", "tie", "start")}
        if kind == COMPARE:
            size = n - 1 + length
            bucket = bucket_of(got["anchor"], buckets)
            order = np.argsort(bucket, kind="stable")
            batch = packed(bucket[order], {x: v[order] for x, v in names.items()} | {"n": got["n"][order]}, kind)
            taken, edges = symbols[ragged(begin[order], size[order])], np.cumsum(size[order])
            last = np.searchsorted(bucket[order], np.asarray(batch["bucket"]), "right")
            cuts = np.concatenate(([0], edges[last - 1]))
            held = pa.array([taken[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        else:
            names = {x: np.repeat(v, n) for x, v in names.items()} | {"start": ragged(got["start"], n)}
            pair = window_hashes(symbols, begin, n, length)
            order = np.lexsort((names["start"], names["doc"], pair[1], pair[0]))
            names, pair = {x: v[order] for x, v in names.items()}, [p[order] for p in pair]
            again, lead = _not_first(names, np.cumsum(np.concatenate(([True], (pair[0][1:] != pair[0][:-1]) | (pair[1][1:] != pair[1][:-1])))))
            names |= {"n": np.ones(len(order), np.int32), "anchor": pair[0], "content": pair[1]} | {f"of_{x}": names[x][lead] for x in ("doc", "tie", "start")}
            for which, k, columns in ((again, COPY, (*_PLACE, *_OF)), (~again, SPREAD, _SEGMENT)):
                if which.any():
                    batch = packed(bucket_of(pair[0][which], buckets), {x: names[x][which] for x in columns}, k)
                    out.append(pa.RecordBatch.from_arrays([*batch.columns, pa.array([b""] * len(batch), pa.binary())], schema=_DEALT))
            continue
        out.append(pa.RecordBatch.from_arrays([*batch.columns, held], schema=_DEALT))
    return pa.Table.from_batches(out, _DEALT)


_DEALT = pa.schema([*_SENT, ("symbols", pa.binary())])


def _not_first(names: dict[str, np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by (group, doc, start): whether an earlier one is in the group, and the group's first."""
    edge = np.concatenate(([True], group[1:] != group[:-1]))
    lead = np.maximum.accumulate(np.where(edge, np.arange(len(group)), 0))
    return ~edge & ((names["doc"] != names["doc"][lead]) | (names["start"] != names["start"][lead])), lead


@tidied
def _compare(table: pa.Table, buckets: int, unit: str, length: int, method: Callable) -> pa.Table:
    """Step 2, for the anchors of a bucket: windows that are repeated, found by `method`, and windows that are suspected copies."""
    kind = table["kind"].to_numpy()
    out = []
    copies = [unpacked(table.filter(pa.array(kind == COPY)), [*_PLACE, *_OF])]
    if (kind == COMPARE).any():
        part = table.filter(pa.array(kind == COMPARE))
        got = unpacked(part, _PLACE)
        symbols = np.frombuffer(b"".join(part["symbols"].to_pylist()), np.uint8 if unit == "bytes" else np.uint64)
        n = got["n"].astype(np.int64)
        begin = np.cumsum(n - 1 + length) - (n - 1 + length)
        again = method(symbols, ragged(begin, n), np.repeat(got["doc"], n), ragged(got["start"], n), length)
        owner, start = np.repeat(np.arange(len(n)), n)[again], ragged(got["start"], n)[again]
        # Neighbouring windows of a segment together.
        at = np.flatnonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(start) != 1)))) if len(owner) else owner
        found = {"doc": got["doc"][owner[at]], "tie": got["tie"][owner[at]], "start": start[at], "n": np.diff(np.append(at, len(owner))).astype(np.int32)}
        out.append(packed(bucket_of(found["doc"], buckets), found, REPEATED))
    if (kind == SPREAD).any():
        got = unpacked(table.filter(pa.array(kind == SPREAD)), list(_SEGMENT))
        order = np.lexsort((got["start"], got["doc"], got["content"], got["anchor"]))
        got = {x: v[order] for x, v in got.items()}
        again, lead = _not_first(got, np.cumsum(np.concatenate(([True], (got["anchor"][1:] != got["anchor"][:-1]) | (got["content"][1:] != got["content"][:-1])))))
        copies.append({x: got[x][again] for x in _PLACE} | {f"of_{x}": got[x][lead[again]] for x in ("doc", "tie", "start")})
    copy = {x: np.concatenate([c[x] for c in copies]) for x in copies[0]}
    out.append(packed(bucket_of(copy["doc"], buckets), copy, COPY))
    return pa.Table.from_batches(out, _SENT)


def _stretches(told: pa.Table, length: int) -> dict[str, np.ndarray]:
    """Suspected copies, neighbouring ones with one source together: doc, tie, start, n (windows), the source's place, and size (symbols)."""
    got = unpacked(told.filter(pa.array(told["kind"].to_numpy() == COPY)), [*_PLACE, *_OF])
    off = got["start"] - got["of_start"]
    order = np.lexsort((got["start"], off, got["of_tie"], got["of_doc"], got["tie"], got["doc"]))
    got, off = {x: v[order] for x, v in got.items()}, off[order]
    new = np.ones(len(order), bool)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for v in (got["doc"], got["tie"], got["of_doc"], got["of_tie"], off):
            same &= v[1:] == v[:-1]
        new[1:] = ~(same & (got["start"][1:] <= got["start"][:-1] + got["n"][:-1]))
    at = np.flatnonzero(new)
    out = {x: v[at] for x, v in got.items()}
    last = np.maximum.reduceat(got["start"] + got["n"], at) if len(at) else np.zeros(0, np.int64)
    out["n"] = (last - out["start"]).astype(np.int64)
    return out | {"size": out["n"] - 1 + length}


_ASKED = pa.schema([("bucket", pa.int64()), ("to", pa.int64()), ("of_doc", pa.int64()), ("of_tie", pa.int32()), ("of_start", pa.int64()), ("size", pa.int64())])
_ASKED_SQL = "bucket long, to long, of_doc long, of_tie int, of_start long, size long"


@tidied
def _ask(told: pa.Table, buckets: int, length: int) -> pa.Table:
    """Step 3: the stretches of sources that a bucket of documents needs; those that overlap or touch are asked for as one."""
    got = _stretches(told, length)
    order = np.lexsort((got["of_start"], got["of_tie"], got["of_doc"]))
    doc, tie, start = (got[x][order] for x in _OF)
    if not len(order):
        return _ASKED.empty_table()
    end = start + got["size"][order]
    owner = np.cumsum(np.concatenate(([False], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))))
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + owner * wide) - owner * wide  # the farthest end so far in the same text
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])))
    at = np.flatnonzero(new)
    size = np.maximum.reduceat(end, at) - start[at]
    return pa.table([pa.array(bucket_of(doc[at], buckets)), pa.array(np.full(len(at), told["bucket"][0].as_py())), pa.array(doc[at]), pa.array(tie[at], pa.int32()), pa.array(start[at]), pa.array(size)], schema=_ASKED)


def _cells(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every symbol of texts laid end to end, and the offsets of each text's symbols."""
    if unit == "bytes":
        at = np.arange(len(data))
        return at, at + 1, offsets
    starts, ends, owner = words(data, offsets)
    return starts, ends, np.searchsorted(owner, np.arange(len(offsets)))


@tidied
def _answer(texts: pa.Table, asked: pa.Table, unit: str) -> pa.Table:
    """Step 3, in the task that holds the sources: the symbols that were asked for, by the bucket that wants them."""
    doc, tie, data, offsets = _opened(texts)
    if not len(doc) or not len(asked):
        return _DEALT.empty_table()
    begin, end, places = _cells(data, offsets, unit)
    _, one = np.unique(np.rec.fromarrays([doc, tie]), return_index=True)
    want = {x: asked[f"of_{x}"].to_numpy() for x in ("doc", "tie")}
    entry, row = _rows_of(doc[one], tie[one], want)
    start, size, to = (asked[x].to_numpy()[entry] for x in ("of_start", "size", "to"))
    first = places[one[row]] + start
    a, b = begin[first], end[first + size - 1]
    order = np.argsort(to, kind="stable")
    codec, out = pa.Codec("zstd", 1), []
    for own in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        raw = np.concatenate([data[a[i] : b[i]] for i in own]).tobytes()
        columns = {"of_doc": want["doc"][entry[own]], "of_tie": want["tie"][entry[own]].astype(np.int32), "of_start": start[own], "start": b[own] - a[own]}
        batch = packed(to[own], columns, SOURCE)
        out.append(pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)], pa.binary())], schema=_DEALT))
    return pa.Table.from_batches(out, _DEALT)


def _confirmed(told: pa.Table, texts: tuple[np.ndarray, ...], cells: tuple[np.ndarray, ...], unit: str, length: int, aligned: Callable) -> dict[str, np.ndarray]:
    """Step 3, in the task that holds the copies: windows of stretches that `aligned` finds equal to their sources."""
    doc, tie, data, _ = texts
    begin, end, places = cells
    got, sources = _stretches(told, length), told.filter(pa.array(told["kind"].to_numpy() == SOURCE))
    if not len(got["doc"]) or not len(sources) or not len(doc):
        return {x: np.zeros(0, _KINDS[x]) for x in _PLACE}
    codec = pa.Codec("zstd")
    raw = b"".join(codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in sources["symbols"].to_pylist())
    held = unpacked(sources, [*_OF, "start"])  # start: the source's bytes
    other = np.frombuffer(raw, np.uint8)
    edges = np.concatenate(([0], np.cumsum(held["start"])))
    other_begin, other_end, other_places = _cells(other, edges, unit)
    # The source stretch of each copy is the last one that begins at or before it, in the same text.
    keys = np.rec.fromarrays([held[x] for x in _OF])
    order = np.argsort(keys, order=keys.dtype.names)
    source = order[np.searchsorted(keys[order], np.rec.fromarrays([got[x] for x in _OF], dtype=keys.dtype), "right") - 1]
    there = other_places[source] + got["of_start"] - held["of_start"][source]
    _, one = np.unique(np.rec.fromarrays([doc, tie]), return_index=True)
    entry, row = _rows_of(doc[one], tie[one], got)
    here, size = places[one[row]] + got["start"][entry], got["size"][entry]
    there = there[entry]
    found: list[dict[str, np.ndarray]] = []
    weight = np.cumsum(end[here + size - 1] - begin[here]) // PART
    for own in np.split(np.arange(len(entry)), np.flatnonzero(np.diff(weight)) + 1):
        mine, its = ragged(here[own], size[own]), ragged(there[own], size[own])
        edge = np.cumsum(size[own]) - size[own]
        agree = aligned(data, begin[mine], end[mine], other, other_begin[its], other_end[its], edge, length)
        # A window counts if all its symbols agree: no disagreement from its first symbol to its last.
        off = np.concatenate(([0], np.cumsum(~agree)))
        windows = size[own] - length + 1
        place = ragged(edge, windows)
        whole = off[place + length] == off[place]
        owner, start = np.repeat(own, windows)[whole], (ragged(np.zeros(len(own), np.int64), windows) + np.repeat(got["start"][entry[own]], windows))[whole]
        at = np.flatnonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(start) != 1)))) if len(owner) else owner
        found.append({"doc": got["doc"][entry[owner[at]]], "tie": got["tie"][entry[owner[at]]], "start": start[at], "n": np.diff(np.append(at, len(owner))).astype(np.int32)})
    return {x: np.concatenate([f[x] for f in found]) for x in _PLACE}


@tidied
def _remove(texts: pa.Table, told: pa.Table, unit: str, length: int, aligned: Callable) -> pa.Table:
    """Step 4: each text's spans and what is left of it."""
    doc, tie, data, offsets = opened = _opened(texts)
    starts, ends, places = cells = _cells(data, offsets, unit)
    sure, copied = unpacked(told.filter(pa.array(told["kind"].to_numpy() == REPEATED)), _PLACE), _confirmed(told, opened, cells, unit, length, aligned)
    got = {x: np.concatenate((sure[x], copied[x])) for x in _PLACE}
    mark = np.zeros(places[-1] + 1, np.int32)
    if len(got["doc"]) and len(doc):
        entry, row = _rows_of(doc, tie, got)
        begin = places[row] + got["start"][entry]
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + got["n"][entry] - 1 + length, -1)
    gone = np.cumsum(mark, dtype=np.int32)[:-1] > 0
    row_of = np.repeat(np.arange(len(doc), dtype=np.int32), np.diff(places))
    lead = gone & ~(np.concatenate(([False], gone[:-1])) & np.concatenate(([False], row_of[1:] == row_of[:-1])) if len(gone) else gone)
    tail = gone & ~(np.concatenate((gone[1:], [False])) & np.concatenate((row_of[1:] == row_of[:-1], [False])) if len(gone) else gone)
    a, b = np.flatnonzero(lead), np.flatnonzero(tail) + 1
    spans = np.bincount(row_of[a], minlength=len(doc))
    base = places[:-1][row_of[a]]
    span_type = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(spans))), pa.int32()), pa.StructArray.from_arrays([pa.array(a - base), pa.array(b - base)], fields=list(span_type)))
    removed = np.bincount(row_of[gone], minlength=len(doc))
    if unit == "bytes":
        kept, size = data[~gone], np.diff(offsets) - removed
    else:
        stay = ~gone
        s, width = starts[stay], ends[stay] - starts[stay]
        lasts = np.concatenate((row_of[stay][1:] != row_of[stay][:-1], [True])) if stay.any() else np.zeros(0, bool)
        room = width + ~lasts
        kept = np.full(room.sum(), 32, np.uint8)
        kept[ragged(np.cumsum(room) - room, width)] = data[ragged(s, width)]
        size = np.bincount(row_of[stay], room, len(doc)).astype(np.int64)
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(kept.tobytes())])
    return pa.Table.from_arrays([pa.array(doc), pa.array(tie), pa.array(np.diff(places)), pa.array(removed), lists, values.cast(pa.binary())], names=["doc_id", "tie", "n", "n_removed", "spans", "kept"])


def numbered(documents: DataFrame, id_column: str, text_column: str, whole: bool = False) -> DataFrame:
    """(doc_id, tie, text). tie is 0, but where rows share an id it numbers their different texts. With whole, rows without an id stay, and the input row is beside them as `row`."""
    rows = ids(documents, id_column, text_column)
    if whole:
        rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.struct("*").alias("row"))
    if rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.withColumn("tie", F.lit(0))
    return rows.withColumn("tie", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("text"))) - 1)


def remove_repeats(documents: DataFrame, unit: str, length: int, gram: int, method: Callable, aligned: Callable, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, tie, n, n_removed, spans (start, end in units) and kept (bytes) of every row with an id.

    method(symbols, places, doc, start, length) says which of the windows symbols[place : place + length] have an equal
    one with a smaller (doc, start). aligned(data, begin, end, other, other_begin, other_end, edges, length) says which symbols of stretches, laid end to
    end from each edge on, are equal to the symbols of their sources at the same place.
    """
    texts = numbered(documents, id_column, text_column)
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(total / BUCKET_BYTES))
    sent = texts.mapInArrow(lambda it: _send(it, buckets, unit, length, gram), _SENT_SQL)
    decided = cut(sent.groupBy("bucket").applyInArrow(lambda t: _gather(t, buckets, hot), _SENT_SQL))
    shelf = lambda: texts.mapInArrow(lambda it: _texts(it, buckets), "bucket long, doc binary, tie binary, size binary, bytes binary, n_bytes long").groupBy("bucket")
    wanted = decided.where(F.col("kind").isin(COMPARE, SPREAD)).groupBy("bucket")
    dealt = shelf().cogroup(wanted).applyInArrow(lambda t, w: _compare_input(t, w, buckets, unit, length), f"{_SENT_SQL}, symbols binary")
    compared = cut(dealt.groupBy("bucket").applyInArrow(lambda t: _compare(t, buckets, unit, length, method), _SENT_SQL))
    told = decided.where(F.col("kind") == COPY).union(compared)
    asked = told.where(F.col("kind") == COPY).groupBy("bucket").applyInArrow(lambda t: _ask(t, buckets, length), _ASKED_SQL)
    sources = shelf().cogroup(asked.groupBy("bucket")).applyInArrow(lambda t, a: _answer(t, a, unit), f"{_SENT_SQL}, symbols binary")
    told = told.withColumn("symbols", F.lit(None).cast("binary")).unionByName(sources)
    return shelf().cogroup(told.groupBy("bucket")).applyInArrow(lambda t, r: _remove(t, r, unit, length, aligned), "doc_id long, tie int, n long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
