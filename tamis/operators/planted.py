"""Checks of conversations that follow a plan: values that are planted in some turn, changed in another, asked for and answered later.

Where each planted value is said is an index made once, by a join of the turns' runs of words with the conversation's values; each check is then an
interval of turns over that index. What a list holds when it is asked for is replayed from its changes, of which the last one of each item counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import grams as G
from tamis.functions import text as T
from tamis.session import Scratch

#: Words of a planted value at most, and the words for counts that an answer may give.
MOST_WORDS = 3
NUMBERS = "zero one two three four five six seven eight nine ten".split()


def _plain(value: Column) -> Column:
    return F.array_join(T.words(value), " ")


def mentions(turns: DataFrame, values: DataFrame) -> DataFrame:
    """(conv_id, value, turn): the turns that say a value of their conversation, as whole words whatever their case. Values of more than MOST_WORDS words, and without a
    word, are said nowhere; of repeated rows one counts; null texts say nothing."""
    wanted = values.select("conv_id", "value", _plain(F.col("value")).alias("plain")).where("plain <> ''").distinct()
    worded = turns.select("conv_id", "turn", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    runs = F.concat(*(G.grams(F.col("w"), n) for n in range(1, MOST_WORDS + 1)))
    said = worded.select("conv_id", "turn", F.explode_outer(F.array_distinct(runs)).alias("plain")).where("plain is not null")
    return said.join(wanted.hint("merge"), ["conv_id", "plain"]).select("conv_id", "value", "turn").distinct()


def event_codes(turns: DataFrame, schedule: DataFrame, events: DataFrame) -> DataFrame:
    """(conv_id, event, turn, code) of what goes against the plan.

    schedule: (conv_id, value, turn), the turns that are meant to say a value. events: (conv_id, event, answer, last_set, query, answered, stale): the value that
    answers, the turn that set it last, those of the question and the answer, and the values that no longer hold.

    VALUE_EARLY: a value said before the first turn that is meant to (event is null). DIST_LEAK: the answer said between the turn that set it and the question.
    QUERY_RESTATES: the question says it. ANSWER_WRONG: the answer doesn't. ANSWER_STALE: the answer says what no longer holds. Turns that aren't there break nothing.

    The index is a written table that all checks read, and sides that grow with the conversations are merged: as a part of each check's plan it would be made four
    times over, and the driver would hold what is broadcast of it.
    """
    stale = events.select("conv_id", F.explode("stale").alias("value"))
    said = mentions(turns, schedule.select("conv_id", "value").unionByName(events.select("conv_id", F.col("answer").alias("value"))).unionByName(stale))
    said = Scratch(turns.sparkSession, "mentions").keep(said, "said")
    first = schedule.groupBy("conv_id", "value").agg(F.min("turn").alias("first"))
    early = said.join(first.hint("merge"), ["conv_id", "value"]).where("turn < first").select("conv_id", F.lit(None).cast(events.schema["event"].dataType).alias("event"), "turn", F.lit("VALUE_EARLY").alias("code"))
    own = said.withColumnRenamed("value", "answer").join(events.hint("merge"), ["conv_id", "answer"])
    kind = F.when((F.col("turn") > F.col("last_set")) & (F.col("turn") < F.col("query")), "DIST_LEAK").when(F.col("turn") == F.col("query"), "QUERY_RESTATES")
    between = own.select("conv_id", "event", "turn", kind.alias("code")).where("code is not null")
    answered = events.join(turns.select("conv_id", F.col("turn").alias("answered")).distinct().hint("merge"), ["conv_id", "answered"])
    right = said.select("conv_id", F.col("value").alias("answer"), F.col("turn").alias("answered"))
    wrong = answered.join(right.hint("merge"), ["conv_id", "answer", "answered"], "left_anti").select("conv_id", "event", F.col("answered").alias("turn"), F.lit("ANSWER_WRONG").alias("code"))
    old = answered.select("conv_id", "event", "answered", F.explode("stale").alias("value")).join(said.withColumnRenamed("turn", "answered").hint("merge"), ["conv_id", "value", "answered"])
    past = old.select("conv_id", "event", F.col("answered").alias("turn"), F.lit("ANSWER_STALE").alias("code")).distinct()
    return early.unionByName(between).unionByName(wrong).unionByName(past)


def list_codes(turns: DataFrame, changes: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, event, turn, held, code): LIST_STATE where an answer doesn't say how many items its list holds, or says another number too.

    changes: (conv_id, event, item, turn, op), op add or remove; of two changes of an item in one turn the removal counts. asked: (conv_id, event, query, answered). Items are
    counted as they stand before the question; numbers beyond ten can't be said right.
    """
    before = changes.join(asked.select("conv_id", "event", "query").hint("merge"), ["conv_id", "event"]).where("turn < query")
    last = before.groupBy("conv_id", "event", "item").agg(F.max_by("op", F.struct("turn", "op")).alias("op"))
    held = last.groupBy("conv_id", "event").agg(F.count_if(F.col("op") == "add").cast("int").alias("held"))
    replies = turns.select("conv_id", F.col("turn").alias("answered"), F.array_intersect(T.words(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, NUMBERS))).alias("said"))
    state = asked.join(held.hint("merge"), ["conv_id", "event"], "left").join(replies.hint("merge"), ["conv_id", "answered"]).withColumn("held", F.coalesce("held", F.lit(0)))
    want = F.get(F.array(*map(F.lit, NUMBERS)), F.col("held"))
    wrong = state.where(~F.coalesce((F.size("said") == 1) & (F.get("said", F.lit(0)) == want), F.lit(False)))
    return wrong.select("conv_id", "event", F.col("answered").alias("turn"), "held", F.lit("LIST_STATE").alias("code"))
