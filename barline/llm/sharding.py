"""Jump consistent hashing as Spark columns.

A key walks through pseudo-random jumps b < j1 < j2 < ...; its shard among n is the last jump below n. No ring
table is kept, and with one shard more only about 1/(n+1) of the keys move, all of them into the new shard.

The generator multiplies modulo 2**64. Spark's ANSI arithmetic refuses to wrap, so the 64-bit state is held as two
32-bit halves in bigint columns and multiplied in 16-bit limbs: everything stays in DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the published generator, as its two 32-bit halves.
_HIGH, _LOW = divmod(2862933555777941757, 1 << 32)
#: Fewest groups of keys per shard while slots are numbered, and rows of a group beyond which there are more; no task has to hold a whole shard.
GROUPS, GROUP_ROWS = 64, 1 << 18


def _low_product(a: Column, b: int) -> Column:
    """a * b modulo 2**32 for a, b below 2**32."""
    return (a.bitwiseAND(0xFFFF) * F.lit(b) + F.shiftleft((F.shiftright(a, 16) * F.lit(b)).bitwiseAND(0xFFFF), 16)).bitwiseAND(0xFFFFFFFF)


def jump(key: Column, shards: int) -> Column:
    """A struct of the key's shard among `shards`, and among `shards + 1` (grown). A null key gives nulls."""

    def step(state: Column, _: Column) -> Column:
        high, low = state["high"], state["low"]
        small = low.bitwiseAND(0xFFFF) * F.lit(_LOW) + F.lit(1)
        large = F.shiftright(low, 16) * F.lit(_LOW) + F.shiftright(small, 16)
        new_low = F.shiftleft(large.bitwiseAND(0xFFFF), 16).bitwiseOR(small.bitwiseAND(0xFFFF))
        new_high = (F.shiftright(large, 16) + _low_product(high, _LOW) + _low_product(low, _HIGH)).bitwiseAND(0xFFFFFFFF)
        next_jump = F.floor((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(new_high, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(new_high.alias("high"), new_low.alias("low"), state["next"].alias("at"), next_jump.alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    zero = F.lit(0).cast("long")
    key = key.cast("long")
    start = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(0xFFFFFFFF).alias("low"), zero.alias("at"), zero.alias("next"))
    # Each jump is at least one further, so `shards` steps always reach the end.
    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
    found = F.when(key.isNotNull(), end)
    # One walk gives both: the place is looked up in the array of the one result.
    both = F.transform(F.array(found), lambda x: F.struct(x["at"].cast("int").alias("shard"), F.when(x["next"] == shards, F.lit(shards)).otherwise(x["at"]).cast("int").alias("grown")))
    return F.get(both, 0)


def shard_documents(documents: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text", groups: int | None = None) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 16), text_crc32, law ('key'), shard, slot, grown_shard.

    Slots run gapless from 0 in every shard, in the order of (group, doc_id, text checksum, size), where group is a hash
    of the id. Rows are numbered inside groups and shifted by the groups' counts, a small table (a group has about GROUP_ROWS rows, or there
    are GROUPS a shard), so neither a shard nor an equal-text group ever meets in one task.

    Null text: size 16, checksum 0. Null ids: no stable key, the rows leave. Repeated rows take slots of their own.
    An empty table gives no rows; further columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.col(id_column).cast("long")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    groups = groups or max(GROUPS, math.ceil(documents.count() / shards / GROUP_ROWS))
    hashed = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    grouped = lambda df: df.withColumn("_group", (hashed % groups).cast("int"))
    keys = documents.select(key.alias("doc_id")).where("doc_id is not null")
    at = jump(F.col("doc_id"), shards)
    counts = grouped(keys.withColumn("shard", at["shard"])).groupBy("shard", "_group").count()
    before = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    rows = documents.select(key.alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")).where("doc_id is not null")
    rows = grouped(rows.withColumn("_at", at).withColumns({"shard": F.col("_at.shard"), "grown_shard": F.col("_at.grown")})).drop("_at")
    inside = Window.partitionBy("shard", "_group").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("_place", F.row_number().over(inside) - 1)
    return rows.join(F.broadcast(counts), ["shard", "_group"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_place")).cast("long").alias("slot"), "grown_shard")
