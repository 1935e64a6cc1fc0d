"""Walks through trees of messages: (tree, id, parent, role, ...) rows, roots without a parent.

Each step is one join for all trees at once, so the number of joins is the depth of the deepest tree and no tree meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.session import Scratch


def best_path(messages: DataFrame, order: list[str]) -> DataFrame:
    """(tree, step, id, role) of the path that takes, from each root, the first reply by `order` (nulls last) as long as there is one."""
    scratch = Scratch(messages.sparkSession, "path")
    messages = scratch.keep(messages.select(*dict.fromkeys(("tree", "id", "role", "parent", *order))), "messages")
    first = F.min(F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))), "id", "role")).alias("f")
    best = messages.where("parent is not null").groupBy("parent").agg(first).select("parent", "f.id", "f.role")
    best = scratch.keep(best, "best")
    now = scratch.keep(messages.where("parent is null").select("tree", F.lit(0).alias("step"), "id", "role"), "step-0")
    steps = [now]
    while not now.isEmpty():
        after = now.select("tree", "step", F.col("id").alias("parent")).join(best, "parent")
        now = scratch.keep(after.select("tree", (F.col("step") + 1).alias("step"), "id", "role"), f"step-{len(steps)}")
        steps.append(now)
    return _union(steps)


def all_paths(messages: DataFrame) -> DataFrame:
    """(tree, id, role, users) of every message that its root reaches, with the user turns from there to it."""
    scratch = Scratch(messages.sparkSession, "path")
    mine = (F.col("role") == "user").cast("int")
    # written once: what makes and filters the messages would else run again over all texts at each step
    messages = scratch.keep(messages.select("tree", "id", "role", "parent"), "messages")
    now = scratch.keep(messages.where("parent is null").select("tree", "id", "role", mine.alias("users")), "step-0")
    steps = [now]
    while not now.isEmpty():
        replies = messages.where("parent is not null").select("id", "role", "parent", mine.alias("own"))
        after = replies.join(now.select("tree", "users", F.col("id").alias("parent")), "parent")
        now = scratch.keep(after.select("tree", "id", "role", (F.col("users") + F.col("own")).alias("users")), f"step-{len(steps)}")
        steps.append(now)
    return _union(steps)


def _union(steps: list[DataFrame]) -> DataFrame:
    out = steps[0]
    for more in steps[1:]:
        out = out.unionByName(more)
    return out
