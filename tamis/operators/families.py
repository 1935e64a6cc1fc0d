"""Rows that lead to other rows: inflections to the head of their word family, superseded records to the last of their chain, and rows to
donors of other groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.ordered import placed
from tamis.session import Scratch

#: What a word may be an inflection of, as pattern, base and rule.
CONSONANTS = "bcdfghjklmnpqrstvwxz"
INFLECTIONS = (
    (f"^(.+[{CONSONANTS}])ies$", "$1y", "s"),
    ("^(.*(?:s|x|z|ch|sh|o))es$", "$1", "s"),
    ("^(.*[^s])s$", "$1", "s"),
    *((f"^(.{{3,}}){end}$", base, end) for end in ("ed", "ing", "er", "est") for base in ("$1", "$1e")),
    *((f"^(.{{2,}}([{CONSONANTS}]))\\2{end}$", "$1", end) for end in ("ed", "ing", "er", "est")),
    *((f"^(.+[{CONSONANTS}])i{end}$", "$1y", end) for end in ("ed", "er", "est")),
)

#: Rounds after which a chain of steps would be longer than any table.
LONGEST = 48


def bases(word: Column) -> Column:
    """array<struct<base, rule>> of what a word may be an inflection of; none for null."""
    found = (F.when(word.rlike(p), F.struct(F.regexp_replace(word, p, base).alias("base"), F.lit(rule).alias("rule"))) for p, base, rule in INFLECTIONS)
    return F.array_compact(F.array(*found))


def followed(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """(at, end) of a table of steps (at, to): where each row's chain of steps ends. Every round doubles the length of all steps, so a chain of n steps takes
    log2(n) rounds. Each `at` has one step. Steps that lead in a circle have no end and are refused."""
    now = scratch.keep(steps.select("at", "to"), "steps-0")
    for turn in range(1, LONGEST):
        on = now.select(F.col("at").alias("to"), F.col("to").alias("next"))
        moved = scratch.keep(now.join(on, "to", "left").select("at", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), f"steps-{turn}")
        if moved.where("moved").isEmpty():
            return moved.select("at", F.col("to").alias("end"))
        scratch.drop(f"steps-{turn - 1}")
        now = moved.select("at", "to")
    raise ValueError("steps lead in a circle")


def word_families(words: DataFrame, word: str, weight: str, ratio: int = 10) -> DataFrame:
    """(word, head, base, rule) of every word: the base is the heaviest word of three letters or more that it may be an inflection of, of equally heavy ones the
    first by name and rule, unless the word is more than `ratio` times as heavy; the head is where bases end. Other words are heads.

    Words are unique; null ones are in no family. A base is shorter than its forms, so bases end.
    """
    scratch = Scratch(words.sparkSession, "families")
    known = scratch.keep(words.where(F.col(word).isNotNull()).select(F.col(word).alias("word"), F.col(weight).alias("weight")), "known")
    maybe = known.select("word", "weight", F.explode(bases(F.col("word"))).alias("b")).select("word", "weight", "b.*").where("length(base) >= 3 and length(base) < length(word)")
    real = maybe.join(known.select(F.col("word").alias("base"), F.col("weight").alias("base_weight")), "base").where(F.col("base_weight") * ratio >= F.col("weight"))
    best = scratch.keep(real.groupBy("word").agg(F.min(F.struct((-F.col("base_weight")).alias("w"), "base", "rule")).alias("b")).select("word", "b.base", "b.rule"), "best")
    heads = followed(best.select(F.col("word").alias("at"), F.col("base").alias("to")), scratch)
    out = known.select("word").join(best, "word", "left").join(heads.select(F.col("at").alias("word"), "end"), "word", "left")
    return out.select("word", F.coalesce("end", "word").alias("head"), "base", "rule")


def judged(items: DataFrame, calls: DataFrame, judged_banks: str, keeps: int = 2) -> DataFrame:
    """Items (item, superseded_by, text, bank) with last, status and reason.

    A superseded item is dropped and names the last record of its chain; of equal texts of a bank that are still there the first item stays for
    judging. Of banks that are judged, an item is kept by `keeps` verdicts "keep" of judges (calls: item, judge, verdict; one verdict a judge, of
    repeated ones the least), dropped by another verdict, and pending while verdicts lack. Null texts are equal to each other. Steps go to larger items.
    """
    scratch = Scratch(items.sparkSession, "judged")
    base = scratch.keep(items.select("item", "superseded_by", "text", "bank"), "items")
    chain = followed(base.where("superseded_by is not null").select(F.col("item").alias("at"), F.col("superseded_by").alias("to")), scratch)
    first = base.where("superseded_by is null").groupBy("bank", "text").agg(F.min("item").alias("first"))
    firsts = first.select(F.col("first").alias("item"), F.lit(True).alias("is_first"))
    votes = calls.groupBy("item", "judge").agg(F.min("verdict").alias("verdict")).groupBy("item").agg(F.count_if(F.col("verdict") == "keep").alias("kept_by"), F.count_if(F.col("verdict") != "keep").alias("dropped_by"))
    wide = base.join(chain.select(F.col("at").alias("item"), "end"), "item", "left").join(firsts, "item", "left").join(votes, "item", "left")
    reason = (
        F.when(F.col("superseded_by").isNotNull(), "SUPERSEDED").when(F.col("is_first").isNull(), "DUP_EXACT").when(~F.expr(judged_banks), None)
        .when(F.coalesce("dropped_by", F.lit(0)) > 0, "JUDGE_DROP").when(F.coalesce("kept_by", F.lit(0)) < keeps, "JUDGE_MISSING")
    )
    status = F.when(reason.isNull(), "kept").when(reason == "JUDGE_MISSING", "pending").otherwise("dropped")
    return wide.select("item", "bank", F.coalesce("end", "item").alias("last"), status.alias("status"), reason.alias("reason"))


def even_donors(rows: DataFrame, key: str, group: str) -> DataFrame:
    """(key, donor): for each row one of another group, null if there is none. No row is used twice, unless one group has more than half of all
    rows: then the others serve it in turn, so that their uses differ by one at most.

    Rows lie in the order of group and key; a donor stands as many places on, round the end, as the largest group has rows, so never in the own group.
    Null groups are a group; keys are unique.
    """
    scratch = Scratch(rows.sparkSession, "donors")
    at = placed(rows.select(F.col(key).alias("key"), F.col(group).alias("grp"), F.lit(0).alias("all_rows")), "all_rows", [F.col("grp"), F.col("key")])
    at = scratch.keep(at.select("key", "grp", (F.col("place") - 1).alias("place"), "rows"), "places")
    sizes = at.groupBy("grp").agg(F.count("*").alias("n"), F.min("place").alias("begin"))
    largest = sizes.agg(F.max(F.struct("n", (-F.col("begin")).alias("b"))).alias("x")).select("x.n", (-F.col("x.b")).alias("begin")).head()
    if largest["n"] is None:
        return rows.select(key, F.col(key).alias("donor"))
    most, begin = int(largest["n"]), int(largest["begin"])
    place, whole = F.col("place"), F.col("rows")
    inside = (place >= begin) & (place < begin + most)
    other = F.pmod(place - begin, F.greatest(whole - most, F.lit(1)))  # the n-th row that isn't in the largest group
    other = F.when(whole > most, F.when(other < begin, other).otherwise(other + most))
    within = F.when(place < begin, place).otherwise(place - most) + begin
    wanted = F.when(2 * most <= whole, F.pmod(place + most, whole)).when(inside, other).otherwise(within)
    wants = at.select("key", wanted.alias("wanted"))
    out = wants.join(at.select(F.col("place").alias("wanted"), F.col("key").alias("donor")), "wanted", "left")
    return out.select(F.col("key").alias(key), "donor")
