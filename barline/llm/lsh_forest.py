"""Near-duplicate groups through an LSH forest over MinHash signatures, with every group confirmed on full shingle sets.

A set's signature has TREES * WIDE slots by one-permutation MinHash; empty slots borrow from the next filled one. Every tree
of the forest is a sorted order of WIDE slots of its own. In a tree, sets with a common prefix of at least `depth` slots
are a region; where a region would be far too full by the counts of a bounded sketch, its depth grows.

1. Every set takes its place in every tree with a fingerprint, two bits of each slot. In the sorted order of a region the neighbours,
   which share the longest prefixes, are compared first: those whose fingerprints and sizes don't rule a link out (six
   deviations below the least similarity) join one cluster. Sets that are then outside their region's largest cluster are
   compared with the whole region, so every pair of a region that might be linked lies in one cluster. A task emits one row for
   each member, which names its cluster's first member, never pairs.
2. Clusters of all trees that overlap become one, by rounds of label exchange.
3. Each set of a cluster is sent to it once. The task intersects full sets, all against all, and again emits one row for each
   member: it names the first document that links reach. A cluster of more than CHUNK sets is dealt into chunks, with some
   members in all of them; then those outside the cluster's largest component are sent in blocks to all chunks, so no link is lost.

Sets that are equal are collapsed first. A region that stays too full at the last slot is joined to one cluster as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm._repeats import bucket_of
from barline.llm._spark import cut, ids, tidied, tidy
from barline.llm._text import hashes, lower, mix, pieces, runs, words

TREES, WIDE = 16, 8
SLOTS = TREES * WIDE
NEAR = 3  # neighbours on one side in a sorted order that are compared first
SMALL = 64  # sets of a region that are all compared at once
FULL = 1 << 15  # sets of a region beyond which it grows deeper
BUCKET_SETS = 4096  # sets behind a bucket of regions
CHUNK, MEMBERS = 2048, 1 << 21  # sets, and shingles of them, that one task intersects all against all
SHARED = 128  # about so many members of a cluster of several chunks are in each of them
DENSE = 32  # sets of a chunk that have a shingle, beyond which the shingle goes into a matrix product


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sizes, hashes) of the distinct shingles of runs of texts, sorted within each text. Texts with fewer words have one shingle of them all."""
    for row, _, data, offsets in pieces(column):
        data = lower(data)
        starts, ends, owner = words(data, offsets)
        h = hashes(data, starts, ends)
        count = np.bincount(owner, minlength=len(offsets) - 1)
        got, of = runs(h, shingle), owner[: max(0, len(owner) - shingle + 1)]
        inside = of == owner[shingle - 1 :]
        got, of = got[inside], of[inside]
        first = np.cumsum(count) - count
        for r in np.flatnonzero((count > 0) & (count < shingle)):
            own = h[first[r] : first[r] + count[r]]
            got, of = np.append(got, runs(own, len(own), 0x9FB21C651E98DF25)), np.append(of, r)
        order = np.lexsort((got, of))
        got, of = got[order], of[order]
        new = np.concatenate(([True], (got[1:] != got[:-1]) | (of[1:] != of[:-1]))) if len(got) else np.zeros(0, bool)
        yield row, np.bincount(of[new], minlength=len(offsets) - 1), got[new]


def signatures(sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """SLOTS values of 16 bits for every set; sets without members have zeros."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    x = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    slot = owner * SLOTS + (x >> np.uint64(57)).astype(np.int64) * SLOTS // 128
    least = np.full(n * SLOTS, (1 << 64) - 1, np.uint64)
    value = x & np.uint64((1 << 57) - 1)
    order = np.argsort(slot, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(slot[order]) != 0))) if len(order) else order
    if len(order):
        least[slot[order][edge]] = np.minimum.reduceat(value[order], edge)
    least = least.reshape(n, SLOTS)
    filled = np.concatenate((least, least), 1) != np.uint64((1 << 64) - 1)
    place = np.where(filled, np.arange(2 * SLOTS), 4 * SLOTS)
    ahead = np.minimum.accumulate(place[:, ::-1], 1)[:, ::-1][:, :SLOTS]
    ahead[sizes == 0] = np.arange(SLOTS)
    borrowed = (ahead - np.arange(SLOTS)).astype(np.uint64)
    out = np.take_along_axis(least, ahead % SLOTS, 1)
    out = (mix(out + borrowed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.uint16)
    out[sizes == 0] = 0
    return out


def _profile(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, sizes, h in shingle_sets(batch["text"], shingle):
            ends = np.cumsum(sizes)
            total = lambda v: np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(v)))[np.concatenate(([0], ends))])  # noqa: B023, E731
            keys = [total(mix(h + np.uint64(c))).view(np.int64) for c in (0x632BE59BD9B4E019, 0xE703_7ED1_A0B4_28DB)]
            sig = signatures(sizes, h)
            yield pa.RecordBatch.from_arrays([batch["doc_id"][row : row + len(sizes)], pa.array(sizes), *map(pa.array, keys), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "n", "k1", "k2", "sig"])
    tidy()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SLOTS)


def sketch(sets: DataFrame, cells: int) -> np.ndarray:
    """How many sets have each value, folded to `cells` values, in each slot: SLOTS * cells numbers, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS * cells, np.int64)
        for batch in batches:
            total += np.bincount((_matrix(batch["sig"]) % cells + np.arange(SLOTS) * cells).ravel(), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "count"])

    got = sets.select("sig").mapInArrow(run, "cell long, count long").groupBy("cell").agg(F.sum("count").alias("count")).toPandas()
    out = np.zeros(SLOTS * cells, np.int64)
    out[got["cell"].to_numpy(np.int64)] = got["count"].to_numpy(np.int64)
    return out.reshape(SLOTS, cells)


def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of 0 .. n-1 that each reaches by the links (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]


def fingerprints(sig: np.ndarray) -> np.ndarray:
    """Two bits of each slot, as four numbers."""
    two = (sig & 3).astype(np.uint64).reshape(len(sig), 4, SLOTS // 4)
    return (two << (2 * np.arange(SLOTS // 4, dtype=np.uint64))).sum(2, dtype=np.uint64)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slots in which fingerprints agree; those of different values do by chance in a quarter of cases."""
    odd = x ^ y
    odd = (odd | (odd >> np.uint64(1))) & np.uint64(0x5555555555555555)
    return SLOTS - np.bitwise_count(odd).sum(-1, dtype=np.int64)


class Plausible:
    """Whether sizes and fingerprints leave a link possible. The bound lies six deviations below what linked sets have; small sets fill few slots, so theirs is low."""

    def __init__(self, size: np.ndarray, marks: np.ndarray, share: float):
        self.size, self.marks, self.share = size, marks, share
        p = share + (1 - share) / 4
        filled = SLOTS * -np.expm1(-size / SLOTS) / 2
        self.least = SLOTS * (p - 6 * np.sqrt(p * (1 - p) / np.maximum(filled, 1e-9)))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.size[a], self.size[b]
        fits = np.minimum(x, y) >= self.share * np.maximum(x, y) - 1e-9
        return fits & (agreement(self.marks[a], self.marks[b]) >= np.minimum(self.least[a], self.least[b]))


_PLANTED = "bucket long, key binary, rep binary, size binary, marks binary, slots binary"


def _plant(batches: Iterator[pa.RecordBatch], counts: np.ndarray, depth: int, buckets: int, full: int) -> Iterator[pa.RecordBatch]:
    """Every set's place in every tree: one row for each task's batch and bucket. Bucket -1 has the places in regions that are too full at any depth."""
    cells = counts.shape[1]
    full = full + 4 * counts[0].sum() / cells
    for batch in batches:
        sig, n = _matrix(batch["sig"]), len(batch)
        if not n:
            continue
        common = counts[np.arange(SLOTS), sig % cells]
        keys, slots, hot = [], [], []
        for tree in range(TREES):
            at = slice(tree * WIDE, (tree + 1) * WIDE)
            own, key = sig[:, at], np.full(n, tree + 1, np.uint64)
            least = np.minimum.accumulate(common[:, at], 1)
            going = np.ones(n, bool)
            for i in range(WIDE):
                if i >= depth:
                    going = going & (least[:, i - 1] > full)
                key = np.where(going, mix(key * np.uint64(0x2545F4914F6CDD1D) + own[:, i]), key)
            keys.append(key)
            slots.append(np.ascontiguousarray(own.astype(">u2")).view(">u8").astype(np.uint64))
            hot.append(going & (least[:, -1] > full))
        key, slots, hot = np.concatenate(keys), np.concatenate(slots), np.concatenate(hot)
        rep, size = (np.tile(batch[c].to_numpy(), TREES) for c in ("rep", "n"))
        marks = np.tile(fingerprints(sig), (TREES, 1))
        bucket = np.where(hot, -1, bucket_of(key, buckets))
        order = np.argsort(bucket, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        held = [pa.array([v[g].tobytes() for g in groups], pa.binary()) for v in (key, rep, size.astype(np.int32), marks, slots)]
        yield pa.RecordBatch.from_arrays([pa.array([bucket[g[0]] for g in groups], pa.int64()), *held], names=["bucket", "key", "rep", "size", "marks", "slots"])
    tidy()


_LINK = "a long, b long"


def _link_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _full_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, region) of the regions that are too full; regions have numbers below all ids but by chance of a hash."""
    for batch in batches:
        for key, rep in zip(batch["key"].to_pylist(), batch["rep"].to_pylist(), strict=True):
            yield from _link_table(np.frombuffer(rep, np.int64), np.frombuffer(key, np.int64)).to_batches()


@tidied
def _clusters(table: pa.Table, share: float) -> pa.Table:
    """Of the regions of a bucket: (set, first set of its cluster) of each set that may have a link in its region."""
    read = lambda name, kind, *wide: np.frombuffer(b"".join(table[name].to_pylist()), kind).reshape(-1, *wide)
    key, rep, size, marks, slots = read("key", np.uint64), read("rep", np.int64), read("size", np.int32), read("marks", np.uint64, 4), read("slots", np.uint64, 2)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order  # sets alone in their region leave
    order = order[np.lexsort((rep[order], slots[order, 1], slots[order, 0], key[order]))]
    key, rep, size, marks = key[order], rep[order], size[order], marks[order]
    n = len(key)
    if not n:
        return _link_table(rep, rep)
    region = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    sizes = np.bincount(region)
    plausible, found = Plausible(size.astype(np.int64), marks, share), []
    for step in range(1, SMALL):
        # In the sorted order the nearest ones share the longest prefixes. Large regions take a few steps, small ones all.
        at = np.flatnonzero((region[step:] == region[:-step]) & ((step <= NEAR) | (sizes[region[step:]] <= SMALL)))
        if not len(at):
            break
        at = at[plausible(at, at + step)]
        found.append((at, at + step))
    label = union(n, *map(np.concatenate, zip(*found, strict=True)))
    ends = np.cumsum(sizes)
    for r in np.flatnonzero(sizes > SMALL):
        here = np.arange(ends[r] - sizes[r], ends[r])
        names, count = np.unique(label[here], return_counts=True)
        rest = here[label[here] != names[np.argmax(count)]]
        step = max(1, (1 << 17) // len(here))
        for block in (rest[i : i + step] for i in range(0, len(rest), step)):
            a, b = np.repeat(block, len(here)), np.tile(here, len(block))
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            fits = plausible(a, b)
            found.append((a[fits], b[fits]))
    label = union(n, *map(np.concatenate, zip(*found, strict=True)))
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, label, rep)
    a, b = rep, first[label]
    pairs = np.unique(np.stack((a[a != b], b[a != b]), 1), axis=0)
    return _link_table(pairs[:, 0], pairs[:, 1])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets, above the diagonal. Shingles that few sets have add up one pair at a time, the others by matrix products."""
    m = len(sets)
    both = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(both, kind="stable")
    both, owner = both[order], owner[order]
    column = np.cumsum(np.concatenate(([False], both[1:] != both[:-1])))
    count = np.bincount(column)[column]
    out = np.zeros(m * m, np.float32)
    few = (count > 1) & (count <= DENSE)
    who, what = owner[few], column[few]
    for step in range(1, DENSE):
        at = np.flatnonzero(what[step:] == what[:-step])
        if not len(at):
            break
        np.add.at(out, who[at] * m + who[at + step], np.float32(1))
    out = out.reshape(m, m)  # so far above the diagonal alone, which is all that is asked for
    many = count > DENSE
    who, what = owner[many], column[many]
    what = np.cumsum(np.concatenate(([False], what[1:] != what[:-1]))) if len(what) else what
    for low in range(0, int(what[-1]) + 1 if len(what) else 0, 1024):
        a, b = np.searchsorted(what, (low, low + 1024))
        block = np.zeros((m, 1024), np.float32)
        block[who[a:b], what[a:b] - low] = 1
        out += block @ block.T
    return out


_PLACE = [("component", "ascending"), ("chunk", "ascending"), ("block", "ascending")]
_CONFIRMED = "a long, b long, shingles binary"


def _linked(table: pa.Table, size: np.ndarray, h: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of the chunks of a bucket, by their place: documents, and the first document that links reach in the chunk. Where some rows are stragglers, only their links to other labels count."""
    least, of = similarity
    doc, label, straggler = (table[c].to_numpy() for c in ("doc_id", "label", "straggler"))
    place = np.stack([table[c].to_numpy() for c, _ in _PLACE])
    edges = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1
    a, b, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.cumsum(size)
    for rows in np.split(np.arange(len(doc)), edges):
        if len(rows) < 2:
            continue
        sets = [h[ends[r] - size[r] : ends[r]] for r in rows]
        own = size[rows].astype(np.float64)
        if len(rows) == 2:
            both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]], np.float32)
        else:
            both = overlaps(sets)
        mixed, links = straggler[rows].any(), []
        for i in range(0, len(rows), 128):  # a band of the matrix at a time
            band = both[i : i + 128].astype(np.float64)
            hit = np.triu(of * band >= least * (own[i : i + 128, None] + own[None] - band), i + 1)
            if mixed:
                hit &= (straggler[rows][i : i + 128, None] != straggler[rows][None]) & (label[rows][i : i + 128, None] != label[rows][None])
            x, y = np.nonzero(hit)
            links.append((x + i, y))
        root = union(len(rows), *map(np.concatenate, zip(*links, strict=True)))
        first = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(first, root, doc[rows])
        away = doc[rows] != first[root]
        a.append(doc[rows][away])
        b.append(first[root][away])
    return np.concatenate(a), np.concatenate(b)


@tidied
def _confirm(table: pa.Table, shingle: int, similarity: tuple[int, int]) -> pa.Table:
    """Links of the chunks of a bucket, from texts; and the sets themselves, as rows without b, of clusters that have more chunks."""
    table = table.sort_by(_PLACE)
    found = [(size, h) for _, size, h in shingle_sets(table["text"].combine_chunks(), shingle)]
    size, h = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = _linked(table, size, h, similarity)
    ends, keep = np.cumsum(size), np.flatnonzero(table["keep"].to_numpy(zero_copy_only=False))
    links = pa.table({"a": a, "b": b, "shingles": pa.nulls(len(a), pa.binary())})
    sets = pa.table({"a": table["doc_id"].to_numpy()[keep], "b": pa.nulls(len(keep), pa.int64()), "shingles": pa.array([h[ends[r] - size[r] : ends[r]].tobytes() for r in keep], pa.binary())})
    return pa.concat_tables([links, sets])


@tidied
def _confirm_across(table: pa.Table, similarity: tuple[int, int]) -> pa.Table:
    """Links between stragglers and the other rows of the chunks of a bucket, from sets."""
    table = table.sort_by(_PLACE)
    held = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
    return _link_table(*_linked(table, np.array([len(x) for x in held], np.int64), np.concatenate(held), similarity))


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node that can be reached.

    Every round takes the least label among the neighbours, then the label of that label, so chains shorten by halves.
    """
    both = cut(links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("component")))
    while True:
        told = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("component").alias("near"))
        near = labels.join(told, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        of = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        after = cut(near.join(of, "component", "left").select("node", "old", F.least("component", F.coalesce("beyond", "component")).alias("component")))
        labels = after.select("node", "component")
        if after.where("component <> old").isEmpty():
            return labels


def _share(column: str, salt: int, parts: Column) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(salt)), parts).cast("long")


def confirmed(clusters: DataFrame, sets: DataFrame, rows: DataFrame, shingle: int, similarity: tuple[int, int], chunk: int) -> tuple[DataFrame, bool]:
    """Links (a, b) between documents of one cluster that reach all others which full sets link; whether they are stars already, one for each component."""
    sized = cut(clusters.join(sets.select(F.col("rep").alias("node"), "n"), "node"))
    stats = cut(sized.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).withColumn("chunks", F.ceil(F.greatest(F.col("size") / chunk, F.col("weight") / MEMBERS)).cast("long")))
    totals = stats.agg(F.sum("weight").alias("weight"), F.max("chunks").alias("most")).first()
    buckets = max(64, math.ceil((totals["weight"] or 0) / (1 << 19)))
    members = sized.select("node", "component").distinct().join(stats.select("component", "size", "chunks"), "component").withColumn("own", _share("node", 1, F.col("chunks")))
    everywhere = (F.col("chunks") > 1) & (_share("node", 2, F.ceil(F.col("size") / SHARED)) == 0)
    placed = members.withColumn("chunk", F.explode(F.when(everywhere, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("own"))))

    def dealt(at: DataFrame) -> DataFrame:
        # Tasks are few by bytes and dear by time, so their number is given.
        return at.withColumn("bucket", F.pmod(F.xxhash64("component", "chunk", "block"), F.lit(buckets))).repartition(buckets, "bucket").groupBy("bucket")

    zero = F.lit(0).cast("long")
    # Always a shuffle join, so that no size decides the plan.
    at = placed.withColumns({"block": zero, "label": F.col("node"), "straggler": F.lit(False), "keep": (F.col("chunks") > 1) & (F.col("chunk") == F.col("own"))}).hint("merge")
    sent = rows.join(at, rows["doc_id"] == at["node"]).select("component", "chunk", "block", "doc_id", "text", "label", "straggler", "keep")
    found = cut(dealt(sent).applyInArrow(lambda t: _confirm(t, shingle, similarity), _CONFIRMED))
    links = found.where("b is not null").select("a", "b")
    if (totals["most"] or 0) <= 1:
        return links, True
    split = members.where("chunks > 1")
    told = connected(links.join(split.select(F.col("node").alias("a")), "a", "left_semi")).withColumnRenamed("component", "label")
    split = cut(split.join(told, "node", "left").withColumn("label", F.coalesce("label", "node")))
    largest = split.groupBy("component", "label").count().groupBy("component").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("largest"))
    split = split.join(largest, "component").withColumn("straggler", F.col("label") != F.col("largest"))
    blocks = split.groupBy("component").agg(F.ceil(F.sum(F.col("straggler").cast("long")) / chunk).alias("blocks")).where("blocks > 0")
    split = split.join(blocks, "component").withColumn("of", _share("node", 3, F.col("blocks")))
    every = lambda c: F.explode(F.sequence(zero, F.col(c) - 1))
    heads = ["node", "component", "label"]
    asked = split.where("straggler").select(*heads, every("chunks").alias("chunk"), F.col("of").alias("block"), F.lit(True).alias("straggler"))
    there = split.select(*heads, F.col("own").alias("chunk"), every("blocks").alias("block"), F.lit(False).alias("straggler"))
    held = found.where("b is null").select(F.col("a").alias("node"), "shingles")
    across = asked.unionByName(there).join(held, "node").withColumnRenamed("node", "doc_id")
    return links.union(cut(dealt(across).applyInArrow(lambda t: _confirm_across(t, similarity), _LINK))), False


def components(documents: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100), id_column: str = "doc_id", text_column: str = "text", full: int = FULL, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest id that links reach, the document's own included.

    Two documents are linked if similarity[1] * |intersection| >= similarity[0] * |union| of their sets of shingles of
    lower-cased words (fewer words: all of them as one). Shingles are compared by 64-bit hashes, and sets are equal if their size and two 64-bit sums of
    hashes are. Texts without words, null or empty, have no shingles and no link. Rows that share an id are one document for links, and each of
    them is returned. Rows with a null id leave. An empty table gives no rows; further columns are not read.
    """
    rows = ids(documents, id_column, text_column)
    profile = cut(rows.mapInArrow(lambda it: _profile(it, shingle), "doc_id long, n long, k1 long, k2 long, sig binary"))
    sets = cut(profile.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")))
    n_sets = sets.count()
    depth = 4 if similarity[0] >= 0.85 * similarity[1] else 3
    buckets = max(128, math.ceil(n_sets / BUCKET_SETS))
    held = sketch(sets, 1 << (10 if n_sets < 1 << 20 else 14))
    counts = documents.sparkSession.sparkContext.broadcast(held)
    share = similarity[0] / similarity[1]
    planted = sets.select("rep", "n", "sig").mapInArrow(lambda it: _plant(it, counts.value, depth, buckets, full), _PLANTED)
    near = planted.where("bucket >= 0").groupBy("bucket").applyInArrow(lambda t: _clusters(t, share), _LINK)
    if (held.max(1).reshape(TREES, WIDE) > full).all(1).any():
        near = near.union(planted.where("bucket < 0").mapInArrow(_full_regions, _LINK))
    clusters = connected(near)
    links, stars = confirmed(clusters, sets, rows, shingle, similarity, chunk)
    known = sets.select("k1", "k2", "n", "rep")
    again = profile.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        stars = False
        links = links.union(profile.join(again, "doc_id", "left_semi").join(known, ["k1", "k2", "n"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    labels = links.select(F.col("a").alias("node"), F.col("b").alias("component")) if stars else connected(links)
    known = known.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component"))
    return profile.drop("sig").join(known, ["k1", "k2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
