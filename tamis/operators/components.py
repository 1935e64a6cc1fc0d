"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.session import Scratch


def _all_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u itself: then each v is its component's least, and no round is left to do."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    each = edges.select(ends.alias("e")).groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return each.where("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) long pairs in any direction -> (u, v): each node that isn't its component's least, with that least.

    A round moves every neighbour to the least node known; the number of rounds grows with the logarithm of the largest
    component. Each round's edges are a written table, and so is each least-neighbour table: both sides of the join that
    follows then come straight from an exchange, so a hub's edges can be split over tasks. Self loops and repeats don't matter.
    """

    def least(pairs: DataFrame, name: str) -> DataFrame:
        return scratch.keep(pairs.groupBy("u").agg(F.min("v").alias("m")), name)

    call = scratch.fresh("components")
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, turn = scratch.keep(ordered, f"{call}-edges-0"), 0
    while not _all_stars(now):
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = least(both.select("u", F.least("u", "v").alias("v")), f"{call}-large-{turn}")
        large = both.join(nearest, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, f"{call}-mid-{turn}")
        smallest = least(large, f"{call}-small-{turn}")
        moved = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.keep(moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), f"{call}-edges-{turn}")
        scratch.drop(*(f"{call}-{part}-{turn}" for part in ("large", "mid", "small")), f"{call}-edges-{turn - 1}")
    return now
