"""Training rows of a fixed length from token sequences: chat templates, buckets and packed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.ordered import placed


def templated(turns: Column, roles: dict[str, int], end: int) -> Column:
    """array<struct<id,target>> of turns (structs of role and ids): each is its role's token, its ids and an end token. Only what an
    assistant says, and its end, is to be learned; the first token never is."""
    role_id = lambda r: F.coalesce(*(F.when(r == name, F.lit(i)) for name, i in roles.items()))

    def one(turn: Column) -> Column:
        learn = turn["role"] == "assistant"
        pair = lambda i, t: F.struct(i.cast("int").alias("id"), t.alias("target"))
        return F.concat(F.array(pair(role_id(turn["role"]), F.lit(False))), F.transform(turn["ids"], lambda i: pair(i, learn)), F.array(pair(F.lit(end), learn)))

    return F.flatten(F.transform(turns, one))


def bucketed(rows: DataFrame, key: str, size: str, buckets: list[int], tokens: int) -> DataFrame:
    """(key, bucket, batch): the smallest bucket that holds the row, and batches of tokens // bucket rows in each. Longer rows, and those without a size, have
    neither."""
    bucket = F.coalesce(*(F.when(F.col(size) <= b, F.lit(b)) for b in sorted(buckets)))
    all_ = rows.select(key, bucket.alias("bucket"))
    at = placed(all_.where("bucket is not null"), "bucket", [F.col(key)])
    batch = F.floor((F.col("place") - 1) / F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.col("bucket"))))
    return at.select(key, "bucket", batch.alias("batch")).unionByName(all_.where("bucket is null").select(key, "bucket", F.lit(None).cast("long").alias("batch")))


#: Rows that are packed together, about.
WINDOW = 4096


def first_fits(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each row in turn: the first bin with room. A tree of the rooms' maxima finds it in steps that grow with the logarithm of the bins."""
    width = 1 << max(0, (len(sizes) - 1).bit_length())
    room = [length] * (2 * width)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for row, n in enumerate(sizes.tolist()):
        at = 1
        while at < width:
            at = 2 * at if room[2 * at] >= n else 2 * at + 1
        bins[row], offsets[row] = at - width, length - room[at]
        room[at] -= n
        while at > 1:
            at >>= 1
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins, offsets


def packed(rows: DataFrame, key: str, size: str, length: int, windows: int | None = None) -> DataFrame:
    """(key, window, bin, offset, reason): rows of 1 to `length` tokens packed into bins of that length, the longest first, each into the first
    bin with room. Windows are drawn by a hash of the key, so many that one holds about WINDOW rows unless they are given. Rows that can't be packed have neither
    bin nor offset, and a reason: too_long, or empty (null sizes too)."""
    windows = windows or 1 + rows.count() // WINDOW
    n = F.col(size).cast("long")
    reason = F.when(n > length, "too_long").when(F.coalesce(n, F.lit(0)) < 1, "empty")
    every = rows.select(F.col(key).alias("key"), n.alias("n"), F.pmod(F.xxhash64(key), F.lit(windows)).cast("int").alias("window"), reason.alias("reason"))
    kind = rows.schema[key].dataType.simpleString()

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "key"], ascending=[False, True], kind="stable")
        bins, offsets = first_fits(frame["n"].to_numpy(), length)
        return pd.DataFrame({"key": frame["key"], "window": frame["window"], "bin": bins, "offset": offsets})

    held = every.where("reason is null").select("key", "n", "window").groupBy("window").applyInPandas(pack, f"key {kind}, window int, bin int, offset int")
    none = every.where("reason is not null").select("key", "window", F.lit(None).cast("int").alias("bin"), F.lit(None).cast("int").alias("offset"), "reason")
    return held.withColumn("reason", F.lit(None).cast("string")).unionByName(none).withColumnRenamed("key", key)


def documents_of(tokens: DataFrame, end: int) -> DataFrame:
    """(shard, doc, start, tokens) of documents in shards of token ids, cut after each end token; what follows the last one is a document too."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for shard, ids in zip(frame["shard"], frame["ids"]):
                ends = np.flatnonzero(np.asarray(ids) == end) + 1
                starts = np.concatenate([[0], ends])
                stops = np.concatenate([ends, [len(ids)]])
                some = stops > starts
                yield pd.DataFrame({"shard": shard, "doc": np.arange(some.sum()), "start": starts[some], "tokens": (stops - starts)[some]})

    return tokens.select("shard", "ids").mapInPandas(cut, "shard int, doc int, start long, tokens long")


def loader_order(shares: list[float], sizes: list[list[int]], count: int) -> list[int]:
    """Which source gives each of the next items: the one that is furthest behind its share of the tokens drawn so far. For the driver's
    plan of one window; sizes are the sources' next items."""
    whole, drawn, at, order = sum(shares), np.zeros(len(shares)), [0] * len(shares), []
    share = np.array(shares) / whole
    while len(order) < count:
        left = np.array([at[i] < len(s) for i, s in enumerate(sizes)])
        if not left.any():
            break
        source = int(np.argmax(np.where(left, share * drawn.sum() - drawn, -np.inf)))
        drawn[source] += sizes[source][at[source]]
        at[source] += 1
        order.append(source)
    return order
