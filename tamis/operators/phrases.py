"""The heaviest phrases of all texts: exact counts, without a row for each phrase that occurs.

Phrases are told apart by a hash into a fixed number of slots first. What a slot holds in all is a bound on each of its phrases, so the phrases
of the heaviest slots are counted by their words, and then those of any other slot whose bound reaches the last place that these leave: no
phrase of the answer can lie elsewhere. Before that a task shuffles a row for each slot at most, whatever its texts; where no phrase
stands out all slots are counted, which is what counting all phrases costs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.session import Scratch

#: Slots of the phrases of one length, and those that are counted first.
SLOTS, FIRST = 1 << 17, 1024


def heaviest(texts: DataFrame, sizes: Sequence[int], most: int, text: str = "text", by_text: bool = False, slots: int = SLOTS, first: int = FIRST) -> DataFrame:
    """(phrase, n, gain): the `most` phrases of so many words with the largest gain, ties by the phrase. `n` counts occurrences, or texts that have it
    `by_text`, and the gain is n times the words less one. Texts that are null have no words."""
    scratch = Scratch(texts.sparkSession, "phrases")
    order = (F.desc("gain"), F.col("phrase"))
    words = [f"w{i}" for i in range(max(sizes))]
    row = [F.monotonically_increasing_id().alias("row")] if by_text else []
    own = ["row"] if by_text else []
    # A row for each word with those that follow it; no phrase is joined before it is known to be wanted. Explodes are outer: else Spark repeats their input in a filter.
    worded = texts.select(*row, T.words(F.col(text)).alias("w"))
    runs = F.arrays_zip(*(F.slice("w", i + 1, F.greatest(F.size("w"), F.lit(0))).alias(w) for i, w in enumerate(words)))
    runs = worded.select(*own, F.explode_outer(runs).alias("run")).select(*own, "run.*")
    slot = lambda i, n: F.when(F.col(words[n - 1]).isNotNull(), F.pmod(F.xxhash64(*words[:n]), F.lit(slots)) + i * slots)
    placed = runs.select(*own, *words, *(slot(i, n).alias(f"s{n}") for i, n in enumerate(sizes)))

    def counted(open_slots: DataFrame) -> DataFrame:
        """The heaviest phrases of these slots, which travel as bits: a fixed number of longs."""
        bits = [0] * -(-slots * len(sizes) // 64)
        at, bit = F.floor(F.col("slot") / 64).alias("at"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int")))
        for found in open_slots.groupBy(at).agg(bit.alias("bits")).collect():
            bits[found["at"]] = found["bits"]
        held = F.lit(bits).cast("array<long>")
        is_open = lambda s: F.getbit(F.element_at(held, F.call_function("shiftright", s, F.lit(6)).cast("int") + 1), (s % 64).cast("int")) == 1
        phrases = F.array(*(F.when(is_open(F.col(f"s{n}")), F.concat_ws(" ", *words[:n])) for n in sizes))
        each = placed.select(*own, F.explode_outer(phrases).alias("phrase")).where("phrase is not null")
        each = (each.distinct() if by_text else each).groupBy("phrase").agg(F.count("*").alias("n"))
        return each.select("phrase", "n", ((F.size(F.split("phrase", " ")) - 1) * F.col("n")).alias("gain")).orderBy(*order).limit(most)

    load = placed.select(F.explode_outer(F.array(*(f"s{n}" for n in sizes))).alias("slot")).where("slot is not null").groupBy("slot").agg(F.count("*").alias("n"))
    weight = F.element_at(F.array(*(F.lit(n - 1) for n in sizes)), F.floor(F.col("slot") / slots).cast("int") + 1)
    bounds = scratch.keep(load.select("slot", (weight * F.col("n")).alias("bound")), "bounds")
    begun = scratch.keep(bounds.orderBy(F.desc("bound"), "slot").limit(first), "begun")
    top = scratch.keep(counted(begun), "top")
    found, last = top.agg(F.count("*"), F.min("gain")).head()
    rest = scratch.keep(bounds.where(F.col("bound") >= (last if found == most else 0)).join(begun, "slot", "left_anti"), "rest")
    return (top if rest.isEmpty() else top.unionByName(counted(rest))).orderBy(*order).limit(most)
