"""Sharding by jump consistent hashing, in SQL expressions only.

The published loop draws from a 64-bit linear congruential generator seeded by the key. ANSI mode forbids wrapping
products, so the state is kept as two unsigned 32-bit halves and every partial product stays below 2^63. Each turn of the
loop moves the candidate shard up by at least one, so folding over as many turns as there are shards is always enough: no
turn limit drops a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import Scratch

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
LOW = (1 << 32) - 1


def _times(hi: Column, lo: Column, plus_one: bool = True) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2^64, as unsigned halves."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & LOW
    m1, m0 = m_lo >> 16, m_lo & 0xFFFF
    upper = lo * F.lit(m1)
    low_sum = lo * F.lit(m0) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1 if plus_one else 0)
    cross = hi * F.lit(m0) + F.shiftleft((hi * F.lit(m1)).bitwiseAND(F.lit(0xFFFF)), 16)
    high = F.shiftright(low_sum, 32) + F.shiftright(upper, 16) + lo * F.lit(m_hi) + cross
    return high.bitwiseAND(F.lit(LOW)), low_sum.bitwiseAND(F.lit(LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """Struct of `shard` for `shards` shards and `grown` for one more; a null key counts as 0.

    Both come from one fold: the walk for one more shard passes through the place where the shorter walk stops.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(LOW)).alias("lo"),
        F.lit(0).cast("long").alias("next"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
    )

    def turn(acc: Column, _: Column) -> Column:
        hi, lo = _times(acc["hi"], acc["lo"])
        ratio = F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double")
        moved = F.struct(
            hi.alias("hi"),
            lo.alias("lo"),
            ((acc["next"] + F.lit(1)).cast("double") * ratio).cast("long").alias("next"),
            F.when(acc["next"] < shards, acc["next"]).otherwise(acc["shard"]).alias("shard"),
            acc["next"].alias("grown"),
        )
        return F.when(acc["next"] <= shards, moved).otherwise(acc)

    def picked(acc: Column) -> Column:
        return F.struct(acc["shard"].cast("int").alias("shard"), acc["grown"].cast("int").alias("grown"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, turn, picked)


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    Shard and grown_shard depend on the key and the shard count only. Slots count a shard's rows from 0 without gaps.
    Rows are numbered within (shard, input partition) and shifted by the sizes of earlier partitions, so no task holds a
    whole shard, however large, and equal keys or equal texts do not meet in one task. Null text: size 8, crc32 0.
    Null keys share the shard of key 0. Repeated rows each get a slot. An empty table gives no rows; extra columns are ignored.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(content) + F.lit(8)).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        jump_hash(F.col(key), shards).alias("at"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("seq"),
    ).select("doc_id", "size", "text_crc32", "at.shard", F.col("at.grown").alias("grown_shard"), "part", "seq")
    kept = Scratch(docs.sparkSession, "sharding").keep(placed, "placed")

    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        kept.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "part").orderBy("seq")
    return (
        kept.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")
    )
