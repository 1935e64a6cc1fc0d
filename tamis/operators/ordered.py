"""Places and running totals inside groups of any size.

Rows are cut by ranges of (group, order), so a group that holds most rows lies in many partitions; each is ordered alone, and the
counts and sums of the partitions before it are added. No task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.names import free_name
from tamis.session import Scratch


def placed(rows: DataFrame, group: str, order: list[Column], total: str | None = None) -> DataFrame:
    """The rows with `place` (from 1 in the group's order) and `rows` (the group's), and with `total` also `running` and `whole` sums of it.

    Null groups are a group. Rows that are equal by `order` get places of their own, so `order` should end with a key.
    """
    scratch = Scratch(rows.sparkSession, "ordered")
    part, named = free_name("part", rows), free_name("group", rows)
    kept = scratch.keep(rows.repartitionByRange(F.col(group), *order).withColumn(part, F.spark_partition_id()), "cut")
    sums = [F.sum(total).alias("s")] if total else []
    each = kept.groupBy(F.col(group).alias(named), F.col(part).alias(part + "_")).agg(F.count("*").alias("n"), *sums)
    whole = Window.partitionBy(named)
    before = whole.orderBy(part + "_").rowsBetween(Window.unboundedPreceding, -1)
    shifts = [F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("n").over(whole).alias("rows")]
    if total:
        shifts += [F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"), F.sum("s").over(whole).alias("whole")]
    shift = each.select(named, part + "_", *shifts)
    within = Window.partitionBy(group, part).orderBy(*order)
    out = kept.withColumn("place", F.row_number().over(within))
    if total:
        out = out.withColumn("running", F.sum(total).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(shift, F.col(group).eqNullSafe(F.col(named)) & (F.col(part) == F.col(part + "_")))
    out = out.withColumn("place", F.col("place") + F.col("n0"))
    if total:
        out = out.withColumn("running", F.col("running") + F.col("s0")).drop("s0")
    return out.drop(part, named, part + "_", "n0")


def counted(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, running, whole): how often each value of a group occurs, up to and with it, and how many there are. Equal values are one row before any is
    moved, so none of them can fill a task; null values don't count."""
    each = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return placed(each, group, [F.col(value)], "n")


def quantiles(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, rows, q0, q1, ...): exact quantiles with linear interpolation; null values don't count."""
    at = counted(rows, group, value).withColumn("rows", F.col("whole"))
    spot = lambda q: F.lit(q) * (F.col("rows") - 1)
    holds = lambda place: (F.col("running") - F.col("n") <= place) & (place < F.col("running"))
    wanted = F.lit(False)
    for q in shares:
        wanted = wanted | holds(F.floor(spot(q))) | holds(F.ceil(spot(q)))
    near = at.where(wanted)
    pick = lambda end: F.max(F.when(holds(end), F.col(value)))
    found = []
    for i, q in enumerate(shares):
        low, high, rest = pick(F.floor(spot(q))), pick(F.ceil(spot(q))), F.max(spot(q) - F.floor(spot(q)))
        found.append((low + (high - low) * rest).alias(f"q{i}"))
    return near.groupBy(group).agg(F.max("rows").alias("rows"), *found)


def nearest_rank(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, rows, q): the value at place max(1, ceil(share * rows)); null values don't count."""
    at = counted(rows, group, value)
    place = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("whole")))
    hit = at.where((F.col("running") - F.col("n") < place) & (place <= F.col("running")))
    return hit.select(group, F.col("whole").alias("rows"), F.col(value).alias("q"))
