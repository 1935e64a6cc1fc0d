"""Deterministic splits, prefixes and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import hash_unit
from tamis.operators.ordered import placed


def hash_split(rows: DataFrame, key: Column, seed: str, share: float) -> DataFrame:
    """Adds `held_out`: whether the key's hash unit is below the share. Rows of one key stay together."""
    return rows.withColumn("held_out", hash_unit(F.lit(seed), key) < share)


def seeded_limit(rows: DataFrame, group: str, key: str, seed: str, most: int) -> DataFrame:
    """The first rows of each group by the hash of (seed, key); the limit is pushed below the shuffle."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"), 256)
    window = Window.partitionBy(group).orderBy("__order", key)
    ranked = rows.withColumn("__order", order).withColumn("rank", F.row_number().over(window))
    return ranked.where(F.col("rank") <= most).drop("__order")


def unit_hash(seed: str, *parts: Column) -> Column:
    """A decimal number in [0, 1) from the first 64 bits of the SHA-256 of seed and parts, joined by the unit separator."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(seed), *(p.cast("string") for p in parts)).cast("binary"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("double")
    return (half(1) * F.lit(float(1 << 32)) + half(9)) / F.lit(2.0**64)


def held_out_prefix(rows: DataFrame, group: str, unit: str, size: str, target: Column, order: str) -> DataFrame:
    """The rows with `held_out`: the group's rows of the lowest units whose sizes come closest to the target (of equally close prefixes
    the shorter), lengthened so that rows of one unit stay together. `target` may use `whole`, the group's size."""
    at = placed(rows, group, [F.col(unit), F.col(order)], size)
    gap = F.abs(F.col("running") - F.col("target"))
    cut = at.withColumn("target", target).groupBy(F.col(group).alias("of")).agg(F.min(F.struct(gap.alias("gap"), "place", unit)).alias("c"), F.max("target").alias("target"))
    # no row at all is a prefix too: it is `target` away
    cut = cut.select("of", F.when(F.col("c.gap") < F.col("target"), F.col(f"c.{unit}")).alias("last"))
    return at.join(cut, F.col(group).eqNullSafe(F.col("of"))).withColumn("held_out", F.coalesce(F.col(unit) <= F.col("last"), F.lit(False))).drop("of", "last")


def closest_prefix(sizes: DataFrame, group: str, order: list[str], size: str, target: float) -> DataFrame:
    """For each group the prefix whose total comes closest to `target`; of equally close ones the shorter. (group, rows, total)."""
    running = placed(sizes.select(group, *order, size), group, [F.col(c) for c in order], size)
    best = F.min(F.struct(F.abs(F.col("running") - target).alias("off"), F.col("place").alias("rows"), F.col("running").alias("total")))
    return running.groupBy(group).agg(best.alias("b")).select(group, "b.rows", "b.total")


def first_share(rows: DataFrame, group: str, order: list[Column], share: float, least: int) -> DataFrame:
    """The rows with `place`, as far as max(least, share of the group's rows) reaches in the order."""
    at = placed(rows, group, order)
    return at.where(F.col("place") <= F.greatest(F.lit(least), F.floor(F.col("rows") * share))).drop("rows")
