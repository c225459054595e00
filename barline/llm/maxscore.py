"""Exact top-k inner products by MaxScore over posting lists.

A term is a component together with a sign. Each shard of candidates is indexed once: the posting list of a term holds the
candidates whose component has that sign, largest weight first. A query meets, of each of its components, the list of its own
sign, where contributions are positive; the list's first weight bounds what the term can add. Terms whose bounds together stay
below the k-th best score are non-essential: a candidate on none of the other, essential lists can't win. The essential lists
are traversed into accumulators; the other components are probed in the rows of candidates, largest bound first, and only
while the partial score plus the remaining bounds competes.

The bar rises in two rounds: each query is searched in one shard first, then in the others with the bar found there. Shards keep k rows
a query, and their rows are merged by rank.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm._spark import cut

SHARD, BLOCK = 8192, 1 << 15  # candidates of a shard, queries that meet a shard in one task
PROBED = 8  # components that are probed together


class Index:
    """Rows of a shard, and the posting list of each term: candidates and weights, largest weight first."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, docs: np.ndarray, weights: np.ndarray, edges: np.ndarray):
        self.ids, self.rows, self.docs, self.weights, self.edges = ids, rows, docs, weights, edges
        full = np.diff(edges) > 0
        self.bounds = np.zeros(len(edges) - 1, weights.dtype)
        self.bounds[full] = weights[edges[:-1][full]]
        self.work: Counter[str] = Counter()  # postings and components that were read

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray) -> Index:
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        doc, component = np.nonzero(rows)
        value = rows[doc, component]
        term = 2 * component + (value < 0)
        order = np.lexsort((-np.abs(value), term))
        edges = np.searchsorted(term[order], np.arange(2 * rows.shape[1] + 1))
        return cls(ids, rows, doc[order], np.abs(value)[order], edges)

    def floats(self) -> Index:
        """The same index in float64, for queries whose sums stay exact there."""
        return Index(self.ids, self.rows.astype(np.float64), self.docs, self.weights.astype(np.float64), self.edges)

    def probe(self, rows: np.ndarray, query: np.ndarray, components: np.ndarray) -> np.ndarray:
        self.work["probes"] += len(rows) * len(components)
        return rows[:, components] @ query[components] if len(components) < len(query) // 2 else rows @ np.where(np.isin(np.arange(len(query)), components), query, 0)

    def search(self, own: int, query: np.ndarray, k: int, bar: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates, ties to the smaller id, without `own`. Candidates below the bar may be left out."""
        components = np.flatnonzero(query)
        terms = 2 * components + (query[components] < 0)
        bounds = np.abs(query[components]) * self.bounds[terms]
        order = np.argsort(bounds, kind="stable")
        components, terms, bounds = components[order], terms[order], bounds[order]
        # The heads of the strongest lists give a first bar.
        heads = [self.docs[self.edges[t] : self.edges[t] + 2 * k] for t in terms[-4:]]
        seeds = np.unique(np.concatenate(heads)) if heads else np.zeros(0, np.int64)
        seeds = seeds[self.ids[seeds] != own]
        if len(seeds) >= k:
            best = int(np.partition(self.probe(self.rows[seeds], query, components), len(seeds) - k)[len(seeds) - k])
            bar = best if bar is None else max(bar, best)
        if bar is None or bar <= 0:
            docs, score = np.arange(len(self.ids)), self.probe(self.rows, query, components)
        else:
            reach = np.cumsum(bounds)
            outside = int(np.searchsorted(reach, bar))  # so many terms can't reach the bar together
            rest = int(reach[outside - 1]) if outside else 0
            part = np.zeros(len(self.ids), self.rows.dtype)
            for c, t in zip(components[outside:], terms[outside:], strict=True):
                a, b = self.edges[t], self.edges[t + 1]
                np.add.at(part, self.docs[a:b], abs(query[c]) * self.weights[a:b])
                self.work["postings"] += b - a
            docs = np.flatnonzero(part + rest >= bar)  # on an essential list, since the rest alone stays below the bar
            rows = self.rows[docs]
            score = self.probe(rows, query, components[outside:])  # components of the other sign lower it
            for end in range(outside, 0, -PROBED):
                live = score + rest >= bar
                docs, rows, score = docs[live], rows[live], score[live]
                begin = max(0, end - PROBED)
                score = score + self.probe(rows, query, components[begin:end])
                rest -= int(bounds[begin:end].sum())
        live = self.ids[docs] != own
        if bar is not None:
            live &= score >= bar
        docs, score = docs[live], score[live]
        order = np.lexsort((self.ids[docs], -score))[:k]
        return self.ids[docs[order]], score[order].astype(np.int64)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(lists)), sizes)
    flat = np.arange(offsets[0], offsets[-1])
    out[row, flat - np.repeat(offsets[:-1], sizes)] = values[flat]
    return out


_PARTS = ("ids", "rows", "docs", "weights", "edges")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score; fewer rows where fewer candidates exist.

    Both tables have vec_id (long) and vector (array<long>); missing components count as 0, and rows with a null id, a null
    vector or a null component take no part. Ties go to the smaller vec_id. A candidate with the query's id is the query's own row. Equal query
    rows are one query; the same id with another vector is searched for itself, and its ranks stand beside the first. Equal candidate
    rows are candidates each. Empty tables give no rows. Sums are taken in 64 bits; components whose products exceed them are not supported.

    A shard's index is built once. Queries are dealt into blocks of bounded size, and each block meets each shard in one task.
    """
    sound = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<long>").alias("vector")).where("vec_id is not null and vector is not null and not exists(vector, x -> x is null)")
    queries, candidates = cut(sound(queries).distinct().withColumn("key", F.xxhash64("vector"))), cut(sound(candidates))
    sizes = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).unionAll(candidates.agg(F.count("*"), F.max(F.size("vector")))).collect()
    (n_queries, _), (n, _) = sizes
    width = max(1, *(d or 0 for _, d in sizes))
    shards = max(1, math.ceil(n / shard))

    def build(table: pa.Table) -> pa.Table:
        index = Index.of(table["vec_id"].to_numpy(), _matrix(table["vector"], width))
        return pa.table({"shard": table["shard"][:1].cast(pa.int32()), **{p: pa.array([np.ascontiguousarray(getattr(index, p)).tobytes()], pa.binary()) for p in _PARTS}})

    # Places of rows, not their contents, choose the shard, so that repeated rows spread; the rows lie in the checkpoint folder.
    placed = candidates.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    indexed = cut(placed.groupBy("shard").applyInArrow(build, "shard int, " + ", ".join(f"{p} binary" for p in _PARTS)))

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {c: [np.zeros(0, np.int64)] for c in ("query_id", "key", "vec_id", "score")}
        if len(asked) and len(held):
            read = lambda p, kind=np.int64: np.frombuffer(held[p][0].as_py(), kind)
            index = Index(read("ids"), read("rows").reshape(-1, width), read("docs"), read("weights"), read("edges"))
            vectors = _matrix(asked["vector"], width)
            if float(np.abs(vectors).max(initial=0)) * float(np.abs(index.rows).max(initial=0)) * width < 2**53:
                index, vectors = index.floats(), vectors.astype(np.float64)
            for own, key, vector, bar in zip(asked["vec_id"].to_pylist(), asked["key"].to_pylist(), vectors, asked["bar"].to_pylist(), strict=True):
                ids, score = index.search(own, vector, k, bar)
                for c, v in (("query_id", np.full(len(ids), own)), ("key", np.full(len(ids), key)), ("vec_id", ids), ("score", score)):
                    out[c].append(v)
        return pa.table({c: pa.array(np.concatenate(v), pa.int64()) for c, v in out.items()})

    def searched(asked: DataFrame, blocks: int) -> DataFrame:
        asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "key", F.lit(1)), F.lit(blocks)).cast("int"))
        held = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(meet, "query_id long, key long, vec_id long, score long")

    home = queries.withColumns({"shard": F.pmod(F.xxhash64("vec_id", "key"), F.lit(shards)).cast("int"), "bar": F.lit(None).cast("long")})
    found = cut(searched(home, max(1, math.ceil(n_queries / shards / block))))
    if shards > 1:
        bars = found.groupBy("query_id", "key").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
        again = home.drop("bar").join(bars.withColumnRenamed("query_id", "vec_id"), ["vec_id", "key"], "left")
        others = again.withColumnRenamed("shard", "home").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
        found = found.union(searched(others, max(1, math.ceil(n_queries / block))))
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, scale: float = 256.0, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and vector = floor(scale * component); vectors with null, NaN or infinite components leave."""
    wide = embeddings.select(F.col(id_column).alias("vec_id"), F.col(column).cast("array<double>").alias("e")).where("e is not null and not exists(e, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return wide.select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("vector"))
