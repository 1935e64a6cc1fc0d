"""Queries over conversations: rule checks by turn, copies, loops and whole-conversation deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import grams as G
from tamis.functions import text as T

#: The codes in the order in which the first one counts as a turn's primary fault.
CODES = ("EMPTY_TURN", "DASH", "DIGIT", "MARKDOWN", "NON_ENGLISH", "REPEAT_4GRAM", "TRI_REPEAT")
DASH, DIGIT, MARKDOWN = "—|--", "[0-9]", r"(?:^|\n)(?:#{1,6} |[-*] |```)"
SELF_COPY, ECHO_USER = 0.5, 0.6


def _turns(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


def _coded(turns: DataFrame) -> DataFrame:
    """Adds `codes`, the failed checks of each turn in order."""
    text = F.coalesce("text", F.lit(""))
    worded = turns.withColumn("w", T.words(text))
    ordered = worded.withColumn("four", F.array_sort(G.grams(F.col("w"), 4))).withColumn("three", F.array_sort(G.grams(F.col("w"), 3)))
    tests = (
        F.trim(text) == "", text.rlike(DASH), text.rlike(DIGIT), text.rlike(MARKDOWN), T.non_ascii_letter_ratio(text) > 0,
        G.has_repeat(F.col("four"), 3), G.has_repeat(F.col("three"), 4),
    )
    return ordered.withColumn("codes", F.array_compact(F.array(*(F.when(t, F.lit(c)) for c, t in zip(CODES, tests))))).drop("w", "four", "three")


def code_table(spark, d):
    """Turns by failed check: all, those where it comes first, and those where it is the only one."""
    # outer: of a plain explode Spark infers a filter on the size of `codes`, and works all of it out again there
    each = _coded(_turns(spark, d)).select(F.explode_outer("codes").alias("code"), F.try_element_at("codes", F.lit(1)).alias("first"), F.size("codes").alias("n"))
    return each.where("code is not null").groupBy("code").agg(F.count("*").alias("hits"), F.count_if(F.col("code") == F.col("first")).alias("primary_hits"), F.count_if(F.col("n") == 1).alias("only_hits"))


def copy_checks(spark, d):
    """Assistant turns that hold much of their own last turn or of the user's last: shares of its distinct four-word runs."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda role: F.last(F.when(F.col("role") == role, F.col("g")), ignorenulls=True).over(before)
    worded = _turns(spark, d).select("conv_id", "turn", "role", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    turns = worded.select("conv_id", "turn", "role", G.grams(F.col("w"), 4).alias("g"))
    seen = turns.withColumn("own", last("assistant")).withColumn("user", last("user")).where("role = 'assistant'")
    share = lambda c: F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(G.shared_part(F.col(c), F.col("g")))
    rated = seen.select("conv_id", "turn", F.round(share("own"), 9).alias("own_share"), F.round(share("user"), 9).alias("user_share"))
    return rated.select("*", (F.col("own_share") >= SELF_COPY).alias("self_copy"), (F.col("user_share") >= ECHO_USER).alias("echo_user"))


def loop_rates(spark, d):
    """Of each role's turns with words, how many say the same words as an earlier one of the same conversation and role."""
    said = _turns(spark, d).select("conv_id", "role", "turn", T.words(F.coalesce("text", F.lit(""))).alias("w")).where("size(w) > 0")
    each = said.groupBy("conv_id", "role", F.sha2(F.concat_ws(" ", "w").cast("binary"), 256).alias("h")).agg(F.count("*").alias("n"))
    total = each.groupBy("role").agg(F.sum("n").alias("turns"), F.sum(F.col("n") - 1).alias("repeats"))
    return total.withColumn("rate", F.round(F.col("repeats") / F.col("turns"), 9))


def _rendered(turns: DataFrame, part) -> DataFrame:
    """(conv_id, turns, rendered): a conversation's parts in turn order, one to a line."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", part.alias("part"))))
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(ordered, lambda t: t["part"]), "\n").alias("rendered"))


def chat_render(spark, d):
    """The hash and length of each conversation's text, without the roles' names."""
    whole = _rendered(_turns(spark, d), F.coalesce("text", F.lit("")))
    return whole.select("conv_id", "turns", F.length("rendered").alias("chars"), F.sha2(F.col("rendered").cast("binary"), 256).alias("sha256"))


def chat_dedup(spark, d):
    """The first of all conversations whose roles and folded words are equal, and how many there are."""
    part = F.concat_ws(":", F.coalesce("role", F.lit("")), F.concat_ws(" ", T.words(F.coalesce("text", F.lit("")))))
    whole = _rendered(_turns(spark, d), part)
    return whole.groupBy(F.sha2(F.col("rendered").cast("binary"), 256).alias("h")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")).drop("h")


def message_census(spark, d):
    """Turns, bytes and model phrases by role."""
    turns = _turns(spark, d)
    return turns.groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count_if(G.model_phrase(F.col("text"))).alias("model_phrases"))


_W = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+(?:''\p{L}+)?')"
_GRAMS = "list_transform(range(1, len(w) - {less}), lambda i: array_to_string(w[i:i + {more}], ' '))"
_SHARE = "round(case when {0} is null or len(list_distinct({0})) < 2 then 0 else len(list_intersect(list_distinct({0}), g)) / len(list_distinct({0})) end, 9)"
_PHRASES = "|".join(G.MODEL_PHRASES).replace("'", "''")
ORACLES = {
    "code_table": rf"""
        with t as (select coalesce(text, '') as text, {_W} as w from conversations),
        g as (select *, list_sort({_GRAMS.format(less=2, more=3)}) as four, list_sort({_GRAMS.format(less=1, more=2)}) as three from t),
        c as (select list_filter([case when trim(text) = '' then 'EMPTY_TURN' end, case when regexp_matches(text, '{DASH}') then 'DASH' end,
                case when regexp_matches(text, '{DIGIT}') then 'DIGIT' end, case when regexp_matches(text, '{MARKDOWN}') then 'MARKDOWN' end,
                case when len(regexp_extract_all(text, '\p{{L}}')) > len(regexp_extract_all(text, '[A-Za-z]')) then 'NON_ENGLISH' end,
                case when len(list_filter(range(1, len(four) - 1), lambda i: four[i] = four[i + 2])) > 0 then 'REPEAT_4GRAM' end,
                case when len(list_filter(range(1, len(three) - 2), lambda i: three[i] = three[i + 3])) > 0 then 'TRI_REPEAT' end],
                lambda x: x is not null) as codes from g),
        e as (select codes, unnest(codes) as code from c)
        select code, count(*) as hits, count(*) filter (codes[1] = code) as primary_hits, count(*) filter (len(codes) = 1) as only_hits from e group by code""",
    "copy_checks": rf"""
        with t as (select conv_id, turn, role, {_W} as w from conversations),
        g as (select conv_id, turn, role, {_GRAMS.format(less=2, more=3)} as g from t),
        s as (select *, last_value(case when role = 'assistant' then g end ignore nulls) over o as own,
                     last_value(case when role = 'user' then g end ignore nulls) over o as usr from g
              window o as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)),
        r as (select conv_id, turn, {_SHARE.format("own")} as own_share, {_SHARE.format("usr")} as user_share from s where role = 'assistant')
        select *, own_share >= {SELF_COPY} as self_copy, user_share >= {ECHO_USER} as echo_user from r""",
    "loop_rates": rf"""
        with t as (select conv_id, role, turn, {_W} as w from conversations),
        r as (select role, row_number() over (partition by conv_id, role, w order by turn) > 1 as again from t where len(w) > 0)
        select role, count(*) as turns, count(*) filter (again) as repeats, round(count(*) filter (again) / count(*), 9) as rate from r group by role""",
    "chat_render": """
        with r as (select conv_id, count(*) as turns, string_agg(coalesce(text, ''), chr(10) order by turn) as t from conversations group by conv_id)
        select conv_id, turns, cast(length(t) as integer) as chars, sha256(t) as sha256 from r""",
    "chat_dedup": rf"""
        with r as (select conv_id, string_agg(coalesce(role, '') || ':' || array_to_string({_W}, ' '), chr(10) order by turn) as t from conversations group by conv_id)
        select min(conv_id) as conv_id, count(*) as copies from r group by t""",
    "message_census": rf"""
        select role, count(*) as turns, cast(sum(strlen(text)) as bigint) as bytes,
               count(*) filter (regexp_matches(replace(lower(text), '’', ''''), '{_PHRASES}')) as model_phrases from conversations group by role""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
