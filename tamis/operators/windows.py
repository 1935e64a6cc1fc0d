"""Evaluation windows: long texts and conversations in parts of a bounded number of bytes, each with what stands before it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_places(text: str, most: int, back: int) -> list[int]:
    """Ends, in characters, of parts of at most so many bytes: at the last blank of a part's last `back` characters, else where it is full."""
    ends, at = [], 0
    while at < len(text):
        size = end = at
        used = 0
        while end < len(text) and used + (n := len(text[end].encode("utf-8", "surrogatepass"))) <= max(most, 4):
            used, end = used + n, end + 1
        if end < len(text):
            blank = max(text.rfind(" ", max(size + 1, end - back), end), text.rfind("\n", max(size + 1, end - back), end))
            end = blank + 1 if blank >= 0 else end
        ends.append(end)
        at = end
    return ends


def text_windows(docs: DataFrame, most: int, context: int, back: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, start, stop, context_start) of each text's parts, in characters; a part's context are the parts before it, as many as fit into
    `context` bytes. Null and empty texts have none; the parts of a text cover it without a gap."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame["key"], frame["text"]):
                starts = [0, *cut_places(t or "", most, back)]
                sizes = [len(t[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(starts, starts[1:])] if t else []
                for i, (a, b) in enumerate(zip(starts, starts[1:])):
                    first, room = i, context
                    while first and sizes[first - 1] <= room:
                        room -= sizes[first - 1]
                        first -= 1
                    rows.append((k, i, a, b, starts[first]))
            yield pd.DataFrame(rows, columns=["key", "at", "start", "stop", "context_start"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(cut, f"key {kind}, at int, start int, stop int, context_start int").withColumnRenamed("key", key)


def chat_windows(turns: DataFrame, most: int) -> DataFrame:
    """(conv_id, turn, first, bytes) of each assistant turn: the earliest turn of its context, which takes the newest turns first as long as
    they fit, with the turn itself, into `most` bytes; the turn alone if not even one does."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    line = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", size.alias("n")))).alias("all"))
    each = line.select("conv_id", "all", F.posexplode("all").alias("at", "t")).where("t.role = 'assistant'")
    before = F.reverse(F.slice("all", F.lit(1), F.col("at")))
    start = F.struct(F.col("t.turn").alias("first"), F.col("t.n").cast("long").alias("used"), F.lit(True).alias("open"))

    def step(a, b):
        fits = a["open"] & (a["used"] + b["n"] <= most)
        return F.struct(F.when(fits, b["turn"]).otherwise(a["first"]).alias("first"), F.when(fits, a["used"] + b["n"]).otherwise(a["used"]).alias("used"), fits.alias("open"))

    walked = each.select("conv_id", F.col("t.turn").alias("turn"), F.aggregate(before, start, step).alias("w"))
    return walked.select("conv_id", "turn", F.col("w.first").alias("first"), F.col("w.used").alias("bytes"))
