"""Plans over small tables of totals: byte targets by group, and greedy mixes. Their inputs have a row for each group or kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_targets(groups: DataFrame, total: float, fill: bool = False) -> DataFrame:
    """(name, target) of groups (name, supply, share): what to take from each, in shares of the total.

    Where supply is short the total shrinks until all shares hold; with `fill` short groups give all they have, and the others the rest in their
    shares. By falling need, share over supply, the short groups come first, so running sums along that order tell which they are, and how much
    is left for one share. Groups without a share get nothing; null supply counts as none. There is a row for each group, so the order is one task's.
    """
    plain = groups.select("name", F.coalesce(F.col("supply"), F.lit(0)).cast("double").alias("supply"), F.coalesce(F.col("share"), F.lit(0)).cast("double").alias("share"))
    wanted = F.col("share") > 0
    if not fill:
        shrink = F.least(F.lit(1.0), F.min(F.when(wanted, F.col("supply") / (F.col("share") * total))).over(Window.partitionBy()))
        return plain.select("name", F.when(wanted, F.col("share") * total * shrink).otherwise(0.0).alias("target"))
    order = Window.orderBy((~wanted).cast("int"), F.col("supply") / F.nullif(F.col("share"), F.lit(0.0)), "name")
    so_far, from_here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(total) - F.coalesce(F.sum("supply").over(so_far), F.lit(0.0))
    ranked = plain.withColumn("level", F.when(wanted, left / F.sum("share").over(from_here))).withColumn("short", wanted & (F.col("supply") < F.col("share") * F.col("level")))
    level = F.first(F.when(wanted & ~F.col("short"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.select("name", F.when(~wanted, 0.0).when(F.col("short"), F.col("supply")).otherwise(F.col("share") * level).alias("target"))


def nearest_mix(items: list[tuple[str, str]], target: dict[str, float], count: int, first: str) -> list[str] | None:
    """Keys of `count` (key, kind) items in the order of choice: all of kind `first`, then whichever brings the kinds' shares nearest to the
    target in sum of absolute differences, of equal ones the first. None if there are too few."""
    if len(items) < count:
        return None
    chosen = [i for i in items if i[1] == first][:count]
    rest = {k: [i for i in items if i[1] == k] for k in {k for _, k in items} - {first}}
    place = {i[0]: n for n, i in enumerate(items)}
    have = {k: sum(1 for i in chosen if i[1] == k) for k in target}
    while len(chosen) < count:

        def off(kind: str) -> float:
            after = {k: n + (k == kind) for k, n in have.items()}
            whole = sum(after.values())
            return sum(abs(after[k] / whole - s) for k, s in target.items()) if whole else 0.0

        kind = min((k for k, own in rest.items() if own), key=lambda k: (off(k), place[rest[k][0][0]]))
        chosen.append(rest[kind].pop(0))
        if kind in have:
            have[kind] += 1
    return [key for key, _ in chosen]
