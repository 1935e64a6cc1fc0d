"""Searches along an order of rows of any length: the next row that is large enough, and how many earlier rows are ranked higher.

Rows are cut by ranges of the order. What lies inside a range is found by its own task with array searches; what lies beyond is
found from a table with a row for each range, or pair of ranges, and by a second cut along the values. No task sees another range's rows,
whatever the values are, and nothing is joined by an inequality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import Scratch


def first_at_least(values: np.ndarray, start: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each search the first place from `start` on whose value is `least` or more; len(values) if there is none.

    Maxima of blocks of 2, 4, 8, ... places are climbed until a block holds such a value, and descended into it, all searches together.
    """
    n = len(values)
    found, level = np.full(len(start), n, np.int64), np.full(len(start), -1, np.int64)
    if not n:
        return found
    width = 1 << (n - 1).bit_length()
    levels = [np.concatenate([np.asarray(values, np.float64), np.full(width - n, -np.inf)])]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).max(1))
    open_ = np.flatnonzero(start < n)
    at = np.asarray(start, np.int64).copy()
    for up, maxima in enumerate(levels):
        here, least_here = at[open_], least[open_]
        hit = maxima[here] >= least_here
        beside = ~hit & (here & 1 == 0) & (len(maxima) > 1)  # the block to the right has the same parent
        here[beside] += 1
        hit |= beside & (maxima[here] >= least_here)
        at[open_] = np.where(hit, here, (here + 1) >> 1)
        level[open_[hit]] = up
        open_ = open_[~hit]
        open_ = open_[at[open_] < len(maxima) >> 1]
    hits = np.flatnonzero(level >= 0)
    place, down = at[hits], level[hits]
    for up in range(len(levels) - 1, 0, -1):
        now = np.flatnonzero(down == up)
        child = place[now] << 1
        place[now] = child + (levels[up - 1][child] < least[hits[now]])
        down[now] = up - 1
    found[hits] = place
    return found


def earlier_greater_here(values: np.ndarray) -> np.ndarray:
    """For each place how many places before it hold a greater value: blocks of 1, 2, 4, ... places, each sorted, against the block to their right."""
    n = len(values)
    out, width = np.zeros(n, np.int64), 1
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    block = np.arange(n)
    while width < n:
        pair, right = block // (2 * width), (block // width) & 1 == 1
        left = np.sort(pair[~right] * (n + 1) + rank[~right])
        ends = np.searchsorted(left, (pair[right] + 1) * (n + 1), "left")
        out[right] += ends - np.searchsorted(left, pair[right] * (n + 1) + rank[right], "right")
        width *= 2
    return out


def _whole(frames: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    kept = [f[columns] for f in frames]
    return pd.concat(kept, ignore_index=True) if kept else pd.DataFrame({c: [] for c in columns})


def filled_forward(rows: DataFrame, group: str, value: str, tie: list[str], given: str, name: str, scratch: Scratch) -> DataFrame:
    """The rows with `name`: `given` of the next row in the group, by value and then ties, that has one, or its own; null if none follows.

    Rows are cut by ranges of (group, value, ties), so that a group of any size lies in many tasks; what a range lacks comes from a table of
    the ranges' first ones.
    """
    order = [F.col(group), F.col(value), *map(F.col, tie)]
    cut = scratch.keep(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), scratch.fresh("filled"))
    within = Window.partitionBy(group, "range_").orderBy(*(c.desc() for c in order[1:])).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn(name, F.last(given, ignorenulls=True).over(within))
    first = cut.where(F.col(given).isNotNull()).groupBy(F.col(group).alias("g_"), F.col("range_").alias("r_")).agg(F.min_by(given, F.struct(value, *tie)).alias("first_"))
    every = cut.select(F.col(group).alias("g_"), F.col("range_").alias("r_")).distinct().join(first, ["g_", "r_"], "left")
    later = F.first("first_", ignorenulls=True).over(Window.partitionBy("g_").orderBy("r_").rowsBetween(1, Window.unboundedFollowing))
    shift = every.select("g_", "r_", later.alias("later_"))
    out = own.join(shift, (F.col(group) == F.col("g_")) & (F.col("range_") == F.col("r_")))
    return out.withColumn(name, F.coalesce(name, "later_")).drop("range_", "g_", "r_", "later_")


def next_eligible(rows: DataFrame, key: str, size: str, need: str) -> DataFrame:
    """(key, next): the next row in the order of `key`, from the first again after the last, whose `size` is this row's `need` or more; itself never.

    A row that finds none has a null `next`, as has one with a null need; null sizes never suffice. Keys are unique; rows without one take
    no part. An empty table gives no rows. Sizes and needs are compared as doubles.
    """
    scratch = Scratch(rows.sparkSession, "eligible")
    kind = rows.schema[key].dataType.simpleString()
    plain = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(size).cast("double").alias("size"), F.col(need).cast("double").alias("need"))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = _whole(frames, ["key", "size", "need"])
        if not len(frame):
            return
        sizes = frame["size"].fillna(-np.inf).to_numpy()
        needs = frame["need"].fillna(np.inf).to_numpy()
        at = first_at_least(sizes, np.arange(1, len(frame) + 1), needs)
        keys = np.append(frame["key"].to_numpy(object), None)
        so_far = np.maximum.accumulate(sizes)
        record = np.concatenate([[True], so_far[1:] > so_far[:-1]]) & (sizes > -np.inf)
        yield frame.assign(next=keys[at], record=record, part=TaskContext.get().partitionId())

    found = plain.repartitionByRange("key").sortWithinPartitions("key").mapInPandas(search, f"key {kind}, size double, need double, next {kind}, record boolean, part int")
    cut = scratch.keep(found, "cut")
    parts = cut.groupBy("part").agg(F.max("size").alias("most")).orderBy("part").collect()  # a row for each range
    number, most = np.array([r["part"] for r in parts]), np.array([-np.inf if r["most"] is None else r["most"] for r in parts])

    @F.pandas_udf("int")
    def target(part: pd.Series, need: pd.Series) -> pd.Series:
        own = np.searchsorted(number, part.to_numpy())
        at = first_at_least(np.concatenate([most, most]), own + 1, need.to_numpy())
        return pd.Series(np.where(at <= own + len(number), number[at % len(number)], -1))

    open_ = cut.where("next is null and need is not null").select("key", F.col("need").alias("value"), target("part", "need").alias("part")).where("part >= 0")
    records = cut.where("record").select("part", F.col("size").alias("value"), F.col("key").alias("record"))
    both = open_.select("part", "value", "key", F.lit(None).cast(kind).alias("record"), F.lit(0).alias("side")).unionByName(
        records.select("part", "value", F.lit(None).cast(kind).alias("key"), "record", F.lit(1).alias("side"))
    )
    beyond = filled_forward(both, "part", "value", ["side", "key"], "record", "found", scratch).where("side = 0")
    # a lap that ends at the row itself found nothing
    late = beyond.select(F.col("key").alias("k"), F.when(F.col("found") != F.col("key"), F.col("found")).alias("late"))
    return cut.join(late, F.col("key") == F.col("k"), "left").select(F.col("key").alias(key), F.coalesce("next", "late").alias("next"))


def earlier_greater(rows: DataFrame, key: str, order: list[Column], rank: list[Column], ranges: int | None = None) -> DataFrame:
    """(key, n): how many rows before this one by `order` come after it by `rank`. Both orders end with something unique.

    Rows are cut into so many ranges (as there are shuffle partitions, 1,024 at most, unless given) of the rank and, apart from that, of the order. Counts between different ranges of both come from a
    grid of ranges * ranges numbers; those inside a range of the order, or of the rank, are counted by that range's task. Null values come
    first, as Spark orders them; rows without a key count like any; an empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "earlier")
    ranges = ranges or min(1024, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = rows.schema[key].dataType.simpleString()
    by_order, by_rank = [f"o{i}" for i in range(len(order))], [f"r{i}" for i in range(len(rank))]
    plain = rows.select(F.col(key).alias("key"), *(c.alias(n) for c, n in zip([*order, *rank], [*by_order, *by_rank])))

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Places by rank, so that later tasks compare numbers."""
        at = 0
        for frame in frames:
            yield frame.assign(bin=TaskContext.get().partitionId(), place=np.arange(at, at + len(frame)))[["key", *by_order, "bin", "place"]]
            at += len(frame)

    def along_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = _whole(frames, ["key", "bin", "place"])
        if len(frame):
            value = frame["bin"].to_numpy(np.int64) * (1 << 40) + frame["place"].to_numpy(np.int64)
            yield frame.assign(part=TaskContext.get().partitionId(), near=earlier_greater_here(value))

    def along_rank(group: pd.DataFrame) -> pd.DataFrame:
        """Of one range of ranks, in falling order: the rows before a row that lie in an earlier range of the order."""
        group = group.sort_values("place", ascending=False, kind="stable")
        return pd.DataFrame({"key": group["key"], "part": group["part"], "bin": group["bin"], "near": group["near"] + earlier_greater_here(-group["part"].to_numpy(np.int64))})

    fields = ", ".join(f"{n} {plain.schema[n].dataType.simpleString()}" for n in by_order)
    ranked = plain.repartitionByRange(ranges, *by_rank).sortWithinPartitions(*by_rank).mapInPandas(numbered, f"key {kind}, {fields}, bin int, place long")
    near = ranked.repartitionByRange(ranges, *by_order).sortWithinPartitions(*by_order).mapInPandas(along_order, f"key {kind}, bin int, place long, part int, near long")
    cut = scratch.keep(near, "cut")
    grid = np.zeros((ranges + 1, ranges + 1), np.int64)
    for r in cut.groupBy("part", "bin").agg(F.count("*").alias("n")).collect():  # ranges * ranges rows at most
        grid[r["part"] + 1, r["bin"]] = r["n"]
    before = grid.cumsum(0)[:-1, ::-1].cumsum(1)[:, ::-1]  # [part, bin]: rows of earlier parts in this bin or a higher one

    @F.pandas_udf("long")
    def far(part: pd.Series, bin_: pd.Series) -> pd.Series:
        return pd.Series(before[part.to_numpy(), bin_.to_numpy() + 1])

    both = cut.groupBy("bin").applyInPandas(along_rank, f"key {kind}, part int, bin int, near long")
    return both.select(F.col("key").alias(key), (F.col("near") + far("part", "bin")).alias("n"))
