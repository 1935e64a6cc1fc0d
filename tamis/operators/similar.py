"""Texts that are nearly alike, without comparing all with all: word edits within a cap, similar word sets, and which items a greedy scan accepts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import Scratch

#: So many lists that are equal but for one place meet each other in one go; more are dealt to blocks of about this many.
BLOCK = 1000


def word_edits(a: list[str], b: list[str], cap: int) -> int:
    """Insertions, deletions and replacements of words between two lists; cap + 1 if there are more. Only the cells within `cap` of the diagonal are filled."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > cap:
        return cap + 1
    far = cap + 1
    row = {j: j for j in range(min(cap, len(b)) + 1)}
    for i, word in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - cap), min(len(b), i + cap) + 1):
            across = row.get(j - 1, far) + (word != b[j - 1]) if j else far
            now[j] = min(across, row.get(j, far) + 1, now.get(j - 1, far) + 1, far)
        if min(now.values()) > cap:
            return far
        row = now
    return row[len(b)]


def edits(a: Column, b: Column, cap: int) -> Column:
    """word_edits of two array columns; null if either is."""

    @F.pandas_udf("int")
    def counted(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else word_edits(list(x), list(y), cap) for x, y in zip(left, right)], dtype="Int32")

    return counted(a, b)


def within_edits(rows: DataFrame, key: str, words: str, cap: int, group: str | None = None) -> DataFrame:
    """(a, b, edits): pairs of keys, a < b, of the same group whose word lists are `cap` edits apart or fewer.

    A list of n words is cut into cap + 1 even segments; of two lists so near one segment of the shorter stands unchanged in the longer, at a
    place that the difference of their lengths bounds. So lists meet by a hash of (group, length, segment, words), no pair is missed, and
    what meets is verified. Lists of `cap` words or fewer have empty segments and meet by length. Keys are unique; null keys, lists and
    groups meet nothing. Equal lists are pairs too: make lists distinct first where copies may be many.

    At a cap of one lists meet by what is left without one word instead (_one_edit): half of a short list is a word or two, and what shares a frequent
    one are far more pairs than those an edit apart.
    """
    if cap == 1:
        return _one_edit(rows, key, words, group)
    parts, n = cap + 1, F.size("w")
    plain = rows.select(F.col(key).alias("k"), F.col(words).alias("w"), (F.col(group) if group else F.lit(0)).alias("g")).where("k is not null and w is not null and g is not null")
    begin = lambda i, length: F.floor(i * length / parts).cast("int")
    part = lambda i, length, at: F.xxhash64(F.col("g"), length, i, F.slice("w", at + 1, begin(i + 1, length) - begin(i, length)))
    numbers = F.sequence(F.lit(0), F.lit(cap))
    kept = plain.select("k", "g", n.alias("n"), F.explode(F.transform(numbers, lambda i: part(i, n, begin(i, n)))).alias("h"))

    def probes(gap: Column) -> Column:
        """Hashes by which lists that are `gap` words shorter are met."""
        length, back, on = n - gap, F.floor((F.lit(cap) - gap) / 2).cast("int"), F.floor((F.lit(cap) + gap) / 2).cast("int")

        def at(i: Column) -> Column:
            first = F.greatest(F.lit(0), begin(i, length) - back)
            last = F.least(n - (begin(i + 1, length) - begin(i, length)), begin(i, length) + on)
            return F.transform(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda p: part(i, length, p))

        return F.when(length >= 0, F.flatten(F.transform(numbers, at))).otherwise(F.array().cast("array<bigint>"))

    seeks = plain.select("k", "g", n.alias("n"), F.explode(F.array_distinct(F.flatten(F.transform(numbers, probes)))).alias("h"))
    met = kept.alias("x").join(seeks.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.k") != F.col("y.k")) & (F.col("y.n") - F.col("x.n")).between(0, cap))
    pairs = met.select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b")).distinct()
    left, right = plain.select(F.col("k").alias("a"), F.col("w").alias("wa")), plain.select(F.col("k").alias("b"), F.col("w").alias("wb"))
    checked = pairs.join(left, "a").join(right, "b").withColumn("edits", edits(F.col("wa"), F.col("wb"), cap))
    return checked.where(F.col("edits") <= cap).select("a", "b", "edits")


def _one_edit(rows: DataFrame, key: str, words: str, group: str | None) -> DataFrame:
    """within_edits at a cap of 1. Lists that differ by a replaced word are equal but for one place, and so meet by the place and the rest; of lists that differ
    by a word more, the longer without it is the shorter; equal ones meet as they are.

    Hashes of the rests carry numbers of rows, and only rows whose hash is met fetch their words. Then lists meet by the rest itself: all that meets is
    a pair and meets once, so pairs are neither verified nor made distinct, only written. Lists that share a place and a rest are dealt to blocks, and
    each two blocks meet by themselves, so no task holds all pairs of a frequent line.
    """
    scratch = Scratch(rows.sparkSession, "edits")
    plain = rows.select(F.col(key).alias("k"), F.col(words).alias("w"), (F.col(group) if group else F.lit(0)).alias("g")).where("k is not null and w is not null and g is not null")
    plain = scratch.keep(plain.select(F.monotonically_increasing_id().alias("id"), "k", "w", "g"), "lists")  # written, so a list keeps its number
    # without the word at place i, from 0; the whole list has place -1
    rest = F.concat(F.slice("w", F.lit(1), F.greatest(F.col("i"), F.lit(0))), F.slice("w", F.col("i") + 2, F.size("w") - F.col("i") - 1))
    # places become rows before rests are made: a lambda that makes them is not compiled, and takes four times as long
    hashes = plain.withColumn("i", F.explode_outer(F.sequence(F.lit(-1), F.size("w") - 1))).select("id", "i", F.xxhash64("g", rest).alias("h"))
    alike, placed = Window.partitionBy("h"), Window.partitionBy("h", "i")
    met = hashes.withColumn("n", F.count("*").over(alike)).withColumn("whole", F.count_if(F.col("i") < 0).over(alike)).where("n > 1")
    met = met.withColumn("m", F.count("*").over(placed)).where("m > 1 or (whole > 0 and n > whole)").select("id", "h", "i", "m")
    # words of a run leave the same rest, so the first stands for the run where a word is left out
    first = (F.col("i") == 0) | ((F.col("i") > 0) & ~F.get("w", F.col("i")).eqNullSafe(F.get("w", F.col("i") - 1)))
    known = met.join(plain.hint("merge"), "id").select("id", "h", "i", "m", "k", "g", rest.alias("rest"), F.get("w", F.col("i")).alias("word"), first.alias("first"))
    known = scratch.keep(known, "met")
    scratch.drop("lists")

    def pairs(a: DataFrame, b: DataFrame, keys: list[str], fits: Column | None) -> DataFrame:
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, "g", "rest")]
        both = a.alias("a").join(b.hint("merge").alias("b"), same if fits is None else [*same, fits])
        apart = F.when((F.col("a.i") < 0) & (F.col("b.i") < 0), 0).otherwise(1)
        return both.select(F.least("a.k", "b.k").alias("a"), F.greatest("a.k", "b.k").alias("b"), apart.alias("edits"))

    blocks, block = F.ceil(F.col("m") / BLOCK).cast("int"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = known.where("m > 1").withColumn("blocks", blocks).withColumn("block", block)
    left = dealt.select("*", F.col("block").alias("p"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("q"))
    right = dealt.select("*", F.explode(F.sequence(F.lit(0), "block")).alias("p"), F.col("block").alias("q"))
    once = (F.col("a.block") < F.col("b.block")) | (F.col("a.id") < F.col("b.id"))
    replaced = pairs(left, right, ["h", "i", "p", "q"], once & ((F.col("a.i") < 0) | ~F.col("a.word").eqNullSafe(F.col("b.word"))))
    return replaced.unionByName(pairs(known.where("i < 0"), known.where("first"), ["h"], None))


def similar_sets(rows: DataFrame, key: str, items: str, bound: tuple[int, int], group: str | None = None) -> DataFrame:
    """(a, b): pairs of keys, a < b, of the same group whose sets have a Jaccard similarity of bound[0] / bound[1] or more.

    Members of a set are ordered by how many sets have them, the rarest first; sets that similar share one of their first
    n - ceil(bound * n) + 1. Only those are joined, so a member that all sets have meets nobody, and exact counts decide. Keys are unique;
    repeated members count once; null keys, groups, and null or empty sets are in no pair.
    """
    up, down = bound
    plain = rows.select(F.col(key).alias("k"), F.array_distinct(F.array_compact(items)).alias("s"), (F.col(group) if group else F.lit(0)).alias("g"))
    plain = plain.where("k is not null and g is not null and size(s) > 0")
    scratch = Scratch(rows.sparkSession, "similar")
    each = scratch.keep(plain.select("k", "g", F.size("s").alias("n"), F.explode("s").alias("m")), "members")
    common = each.groupBy("g", "m").agg(F.count("*").alias("sets")).where("sets > 1")
    ordered = each.join(common, ["g", "m"]).groupBy("k", "g", "n").agg(F.array_sort(F.collect_list(F.struct("sets", "m"))).alias("s"))
    # members that no other set has come first, and meet nobody
    first = F.col("n") - F.ceil(F.lit(up) * F.col("n") / F.lit(down)) + 1 - (F.col("n") - F.size("s"))
    heads = scratch.keep(ordered.where(first > 0).select("k", "g", "n", F.explode(F.slice("s", F.lit(1), first.cast("int"))).alias("m")).select("k", "g", "n", "m.m"), "heads")
    a, b = heads.alias("a"), heads.alias("b")
    sizes = (F.col("a.n") * down >= F.col("b.n") * up) & (F.col("b.n") * down >= F.col("a.n") * up)
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.m") == F.col("b.m")) & (F.col("a.k") < F.col("b.k")) & sizes).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()
    both = met.join(plain.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(plain.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * down >= (F.size("sa") + F.size("sb") - shared) * up).select("a", "b")


def first_accepted(items: DataFrame, links: DataFrame, key: str, rank: str) -> DataFrame:
    """(key, owner): what a scan in the order of `rank` does that drops an item if it is linked to an accepted one before it. An accepted item owns
    itself, a dropped one belongs to the first accepted one that it is linked to.

    Links are (a, b) pairs of keys in either direction. In each round the items without an undecided earlier neighbour are accepted and
    their later neighbours dropped, until no link between undecided ones is left: as many rounds as the longest row of decisions
    that hang on each other, a few where ranks aren't ordered along chains. Components would drop items that are tied to accepted ones only by dropped ones. Ranks
    and keys are unique and not null; links of unknown keys and to oneself don't matter.
    """
    scratch = Scratch(items.sparkSession, "accepted")
    ranks = items.select(F.col(key).alias("k"), F.col(rank).alias("r"))
    ends = links.select(F.col("a"), F.col("b")).where("a <> b").join(ranks.select(F.col("k").alias("a"), F.col("r").alias("ra")), "a").join(ranks.select(F.col("k").alias("b"), F.col("r").alias("rb")), "b")
    early = F.col("ra") < F.col("rb")
    edges = ends.select(F.when(early, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(early, F.col("b")).otherwise(F.col("a")).alias("v"), F.least("ra", "rb").alias("r")).distinct()
    all_edges = now = scratch.keep(edges, "edges-0")
    dropped, turn = None, 0
    while not now.isEmpty():
        turn += 1
        waiting = now.select(F.col("v").alias("u")).distinct()
        lost = scratch.keep(now.join(waiting, "u", "left_anti").select("v").distinct(), f"lost-{turn}")
        heads = now.select("u").distinct().join(waiting, "u", "left_anti")
        gone = lost.select(F.col("v").alias("u"))
        # links of what is dropped, and of heads, are settled
        left = now.join(lost, "v", "left_anti").join(gone.unionByName(heads), "u", "left_anti")
        now = scratch.keep(left.select("u", "v", "r"), f"edges-{turn}")
        dropped = lost if dropped is None else dropped.unionByName(lost)
    if dropped is None:
        return items.select(key, F.col(key).alias("owner"))
    dropped = scratch.keep(dropped, "dropped")
    owners = all_edges.join(dropped, "v").join(dropped.select(F.col("v").alias("u")), "u", "left_anti").groupBy("v").agg(F.min_by("u", "r").alias("owner_"))
    return items.select(key).join(owners, F.col(key) == F.col("v"), "left").select(key, F.coalesce("owner_", key).alias("owner"))
