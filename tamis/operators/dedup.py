"""Exact deduplication in a stated order, frequent lines, and paragraphs that stay with their first document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.session import Scratch


def first_by(rows: DataFrame, key: Column, order: list[str], keep: list[str]) -> DataFrame:
    """One row for each key: the least by `order`. The aggregate combines before its shuffle, so copies of a key don't meet in one task."""
    first = F.min(F.struct(*order, *(c for c in keep if c not in order)))
    return rows.groupBy(key.alias("__key")).agg(first.alias("f")).select(*(F.col(f"f.{c}").alias(c) for c in keep))


def lines_of(docs: DataFrame, text: str = "text", mark: str = "\n") -> DataFrame:
    """(doc_id, at, line) of each line that isn't blank."""
    each = docs.select("doc_id", F.posexplode(F.split(F.col(text), mark)).alias("at", "line"))
    return each.withColumn("line", F.trim("line")).where("line <> ''")


def frequent_lines(docs: DataFrame, least: int) -> DataFrame:
    """(line_hash, docs) of lines in at least so many documents. Counts are combined before the shuffle."""
    each = lines_of(docs).select("doc_id", F.sha2(F.col("line").cast("binary"), 256).alias("line_hash")).distinct()
    return each.groupBy("line_hash").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)


def drop_lines(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """(doc_id, kept_lines, dropped_lines) after the lines of `bad` are gone; documents without lines have zeros."""
    each = lines_of(docs).select("doc_id", F.sha2(F.col("line").cast("binary"), 256).alias("line_hash"))
    marked = each.join(bad.select("line_hash", F.lit(1).alias("bad")), "line_hash", "left")
    counts = marked.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("bad").alias("bad"))
    both = docs.select("doc_id").join(counts, "doc_id", "left")
    return both.select("doc_id", F.coalesce(F.col("n") - F.col("bad"), F.lit(0)).alias("kept_lines"), F.coalesce("bad", F.lit(0)).alias("dropped_lines"))


def greedy_reasons(rows: DataFrame, order: list[str], text_key: str, id_key: str) -> DataFrame:
    """(order..., text_key, id_key, reason): kept, dup_exact or dup_id, as one scan in order would say that lets kept rows alone claim their keys.

    Each round keeps every open row that is the first of its text and of its id, and settles all that share a key with one; only chains
    of conflicts need more rounds than one. `order` must end with a key; null keys conflict with nothing.
    """
    scratch = Scratch(rows.sparkSession, "greedy")
    columns = [*order, text_key, id_key]
    place = F.struct(*order)
    rows = scratch.keep(rows.select(*columns), "rows")
    open_, kept, turn = rows, None, 0
    while not open_.isEmpty():
        turn += 1
        marked = open_.withColumn("place", place)
        for key in (text_key, id_key):
            first = marked.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("place").alias(f"first_{key}"))
            marked = marked.join(first, key, "left")
        leads = F.lit(True)
        for key in (text_key, id_key):
            leads = leads & (F.col(key).isNull() | (F.col("place") == F.col(f"first_{key}")))
        now = scratch.keep(marked.where(leads).select(*columns), f"kept-{turn}")
        left = open_
        for key in (text_key, id_key):
            left = left.join(now.where(F.col(key).isNotNull()).select(key), key, "left_anti")
        if turn == 1:  # rows without keys are in no anti join's way, but they are kept
            left = left.where(F.col(text_key).isNotNull() | F.col(id_key).isNotNull())
        left = left.join(now.select(*order), order, "left_anti")
        kept = now if kept is None else kept.unionByName(now)
        open_ = scratch.keep(left.select(*columns), f"open-{turn}")
    if kept is None:
        return rows.withColumn("reason", F.lit("kept"))
    mine = kept.select(*(F.col(c).alias(f"k_{c}") for c in order))
    owner = kept.where(F.col(text_key).isNotNull()).select(F.col(text_key), F.struct(*order).alias("owner"))
    known = rows.join(mine, [F.col(c) == F.col(f"k_{c}") for c in order], "left").join(owner, text_key, "left")
    exact = F.col("owner").isNotNull() & (F.col("owner") < place)
    reason = F.when(F.col(f"k_{order[-1]}").isNotNull(), "kept").when(exact, "dup_exact").otherwise("dup_id")
    return known.select(*columns, reason.alias("reason"))


def frequent_group_lines(docs: DataFrame, group: Column, least: int) -> DataFrame:
    """(line_hash, groups) of lines in at least so many distinct groups; all of a page's versions may be one group."""
    each = lines_of(docs.withColumn("doc_id", group)).select("doc_id", F.sha2(F.col("line").cast("binary"), 256).alias("line_hash")).distinct()
    return each.groupBy("line_hash").agg(F.count("*").alias("groups")).where(F.col("groups") >= least)


def without_lines(docs: DataFrame, bad: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text) of every document without the lines of `bad`; blank lines stay. Null texts stay null; rows that share a key stay rows of
    their own, as do repeated ones."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    each = numbered.select("row", "key", F.posexplode_outer(F.split("text", "\n")).alias("at", "line"))
    each = each.withColumn("line_hash", F.sha2(F.trim("line").cast("binary"), 256))
    left = each.join(bad.select("line_hash", F.lit(True).alias("bad")), "line_hash", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("bad").isNull() & F.col("line").isNotNull(), F.struct("at", "line"))))
    whole = left.groupBy("row", "key").agg(F.max(F.col("line").isNotNull()).alias("any"), ordered.alias("lines"))
    return whole.select(F.col("key").alias(key), F.when(F.col("any"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias(text))
