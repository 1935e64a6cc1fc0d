"""Queries over conversation turns: the registry of checks, reply rules, echoes, templates and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import grams as G
from tamis.functions import text as T
from tamis.operators import checks, minhash, packing, planted
from tamis.plans import measures
from tamis.session import Scratch

RULES = (("caps", ""), ("lowercase", ""), ("first_word", "the"), ("word", "and"), ("question_end", ""), ("brackets", ""))
ROLES, END = {"system": 1, "user": 2, "assistant": 3}, 4


def _turns(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet")


def check_registry(spark, d):
    """Turns by failed check of the whole registry: all, those where it comes first, those where it is the only one."""
    return checks.code_table(checks.checked(_turns(spark, d)))


def accepted_turns(spark, d):
    """Turns by role: all, those without a failed check, and those that only checks which never reject complain of."""
    reports = F.array(*map(F.lit, ("DIGIT", "LEN", "NO_STOPWORD")))
    coded = checks.checked(_turns(spark, d)).select("role", "codes")
    return coded.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(F.size("codes") == 0).alias("clean"), F.count_if(F.size(F.array_except("codes", reports)) == 0).alias("accepted"))


def rule_predicates(spark, d):
    """Assistant replies that keep each rule."""
    replies = _turns(spark, d).where("role = 'assistant'").select(F.coalesce("text", F.lit("")).alias("t"))
    held = replies.agg(F.count("*").alias("n"), *(F.count_if(checks.rule_holds(r, F.col("t"), a)).alias(r) for r, a in RULES))
    return held.select("n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("kept")) for r, _ in RULES))).alias("x")).select("n", "x.rule", "x.kept")


def reply_echoes(spark, d):
    """Of each assistant turn with four words or more the share of its distinct runs of four that stood in an earlier turn of the conversation."""
    worded = _turns(spark, d).select("conv_id", "turn", "role", T.words(F.coalesce("text", F.lit(""))).alias("w"))
    runs = worded.select("conv_id", "turn", "role", F.explode_outer(F.array_distinct(G.grams(F.col("w"), 4))).alias("g")).where("g is not null")
    first = runs.groupBy("conv_id", "g").agg(F.min("turn").alias("first"))
    aged = runs.where("role = 'assistant'").join(first, ["conv_id", "g"])
    share = aged.groupBy("conv_id", "turn").agg(F.round(F.avg((F.col("first") < F.col("turn")).cast("int")), 9).alias("share"))
    return share.select("conv_id", "turn", "share", (F.col("share") >= 0.8).alias("echo"))


def turn_order(spark, d):
    """Conversations by whether their roles run as they should: a system turn first if at all, then user and assistant in turn, from a user on."""
    order = F.array_sort(F.collect_list(F.struct("turn", F.left("role", F.lit(1)).alias("r"))))
    line = _turns(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(order, lambda x: x["r"]), "").alias("line"))
    return line.groupBy(F.col("line").rlike("^s?(?:ua)*u?$").alias("in_order")).agg(F.count("*").alias("conversations"))


def chat_template(spark, d):
    """Tokens and targets of each conversation, with word lengths for ids, and a hash of all of it."""
    ids = F.transform(T.words(F.coalesce("text", F.lit(""))), lambda w: F.length(w) + 10)
    rows = _turns(spark, d).select("conv_id", F.struct("turn", "role", ids.alias("ids")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    made = whole.select("conv_id", packing.templated(F.col("turns"), ROLES, END).alias("x"))
    listed = F.array_join(F.transform("x", lambda p: F.concat(p["id"].cast("string"), F.when(p["target"], "+").otherwise(""))), " ")
    return made.select("conv_id", F.size("x").alias("tokens"), F.size(F.filter("x", lambda p: p["target"])).alias("targets"), F.sha2(listed.cast("binary"), 256).alias("sha256"))


def length_batches(spark, d):
    """Documents by bucket of characters: rows, and batches of 16,384 characters; longer ones are in none."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    at = packing.bucketed(docs, "doc_id", "n_chars", [512, 1024, 2048, 4096], 16_384)
    return at.groupBy("bucket").agg(F.count("*").alias("docs"), F.countDistinct("batch").alias("batches"))


def packed_rows(spark, d):
    """Documents packed into rows of 8,192 characters: by bin how many, the characters they fill, and that none lies on another; by reason those that fit none.

    Bins depend on a hash, so what SQL can say is counted: rows, characters, and that no bin is overfull.
    """
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = packing.packed(docs, "doc_id", "n_chars", 8192).join(docs.select("doc_id", "n_chars"), "doc_id")
    bins = rows.groupBy("window", "bin", "reason").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max(F.col("offset") + F.col("n_chars")).alias("top"))
    sound = F.col("reason").isNotNull() | ((F.col("chars") <= 8192) & (F.col("top") == F.col("chars")))
    return bins.groupBy("reason").agg(F.sum("docs").alias("docs"), F.sum("chars").alias("chars"), F.every(sound).alias("sound"))


def _planned(spark, d) -> DataFrame:
    """Turns by place, their texts with planted values: a token of the conversation is given in the first turn and corrected in the second, the last turn but
    one asks for it and for the number of things in a box, the last one answers. One conversation in six says each thing wrong."""
    turns = _turns(spark, d).select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    whole = Window.partitionBy("conv_id")
    placed = turns.withColumn("at", F.row_number().over(whole.orderBy("turn")) - 1).withColumn("n", F.count("*").over(whole)).where("n >= 4")
    kind, at, last = F.col("conv_id") % 6, F.col("at"), F.col("n") - 1
    old, new = (F.concat(F.lit(w), F.col("conv_id") % 5) for w in ("Korveth ", "Zuldane "))
    old, new = (F.translate(v, "01234", "abcde") for v in (old, new))
    right = F.element_at(F.array(*map(F.lit, planted.NUMBERS)), (2 - (F.col("conv_id") % 2) + 1).cast("int"))
    said = (
        F.when(at == 0, F.concat(F.lit(" my token is "), old, F.lit(". In the box are a stone and a feather."), F.when(kind == 1, F.concat(F.lit(" Or "), new)).otherwise("")))
        .when(at == 1, F.concat(F.lit(" no, it is "), new, F.lit(".")))
        .when(at == last - 1, F.when(kind == 3, F.concat(F.lit(" is it "), new, F.lit("?"))).otherwise(" what is it?"))
        .when(at == last, F.concat(F.lit(" it is "), F.when(kind == 4, old).when(kind == 5, F.concat(new, F.lit(", not "), old)).otherwise(new), F.lit(", and I count "), F.when(kind == 2, "nine").otherwise(right)))
        .otherwise(F.when(kind == 2, F.concat(F.lit(" still "), F.upper(new))).otherwise(""))
    )
    return placed.select("conv_id", F.col("at").alias("turn"), "n", F.concat(F.translate("text", "01234", "     "), F.lit(". ."), said).alias("text"), old.alias("old"), new.alias("new"))


def planned_events(spark, d):
    """Turns that go against the plan of their conversation, by code, and what the list held."""
    turns = Scratch(spark, "planned").keep(_planned(spark, d), "turns")
    one = turns.where("turn = 0")
    schedule = one.select("conv_id", F.explode(F.array(F.struct(F.col("old").alias("value"), F.lit(0).alias("turn")), F.struct(F.col("new").alias("value"), F.lit(1).alias("turn")))).alias("s")).select("conv_id", "s.*")
    events = one.select("conv_id", F.lit("slot").alias("event"), F.col("new").alias("answer"), F.lit(1).alias("last_set"), (F.col("n") - 2).alias("query"), (F.col("n") - 1).alias("answered"), F.array("old").alias("stale"))
    # the feather is taken out again in odd conversations
    change = lambda item, turn, op: F.struct(F.lit(item).alias("item"), F.lit(turn).alias("turn"), F.lit(op).alias("op"))
    made = F.concat(F.array(change("stone", 0, "add"), change("feather", 0, "add")), F.when(F.col("conv_id") % 2 == 1, F.array(change("feather", 1, "remove"))).otherwise(F.array().cast("array<struct<item:string,turn:int,op:string>>")))
    changes = one.select("conv_id", F.lit("box").alias("event"), F.explode(made).alias("c")).select("conv_id", "event", "c.*")
    asked = one.select("conv_id", F.lit("box").alias("event"), (F.col("n") - 2).alias("query"), (F.col("n") - 1).alias("answered"))
    slots = planted.event_codes(turns, schedule, events).select("conv_id", "event", "turn", F.lit(None).cast("int").alias("held"), "code")
    return slots.unionByName(planted.list_codes(turns, changes, asked))


def near_conversations(spark, d):
    """Near-duplicate conversations: groups by five-word shingles of all their turns, of which the first stays."""
    part = F.concat_ws(" ", F.concat(F.lit("role"), F.left("role", F.lit(1))), F.coalesce("text", F.lit("")))
    whole = _turns(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), " ").alias("text"))
    return minhash.near_duplicates(whole, [], key="conv_id")


_W = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+(?:''\p{L}+)?')"
_STOP = "['" + "', '".join(w.replace("'", "''") for w in T.STOPWORDS.split()) + "']"
_PHRASE = "regexp_matches(replace(lower(t), '’', ''''), '(?:^|[^a-z])(?:{})')"
_FOUR = "list_sort(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))"
_AGAIN = "flatten(list_transform(list_filter(range(1, len(w) - {2} + 1), lambda j: w[j:j + {1}] = w[j + {0}:j + {2} - 1]), lambda j: range(j + {0}, j + {2})))"
_COVER = f"len(list_distinct(list_concat({', '.join(_AGAIN.format(n, n - 1, 2 * n) for n in (1, 2, 3, 4))}))) / greatest(len(w), 1) >= 0.25"
_TESTS = {
    "EMPTY_TURN": "trim(t) = ''",
    **{code: f"regexp_matches(t, '{p}')" for code, p in checks.PATTERNS.items()},
    "LEN": "len(w) not between 3 and 60",
    "REPEAT_4GRAM": "len(list_filter(range(1, len(four) - 1), lambda i: four[i] = four[i + 2])) > 0",
    "CONSEC_REP": f"len(w) >= 8 and {_COVER}",
    "NON_ENGLISH": r"len(regexp_extract_all(t, '\p{L}')) > len(regexp_extract_all(t, '[A-Za-z]'))",
    "NO_STOPWORD": f"len(w) >= 8 and not list_has_any(w, {_STOP})",
    "AI_ISM": _PHRASE.format("|".join(checks.ASSISTANT_PHRASES).replace("'", "''")),
    "DEFLECT": "role = 'assistant' and " + _PHRASE.format("|".join(checks.EXCUSES).replace("'", "''")),
    "ASSIST_CASE": "role = 'assistant' and (regexp_matches(regexp_extract(t, '[A-Za-z]'), '^[a-z]') or regexp_matches(t, '{}'))".format(checks.LONE_I.replace("'", "''")),
}
_CODED = f"""select role, list_filter([{", ".join(f"case when {test} then '{code}' end" for code, test in _TESTS.items())}], lambda x: x is not null) as codes
    from (select *, {_FOUR} as four from (select role, coalesce(text, '') as t, {_W} as w from conversations))"""
_LETTERS, _CAPITALS, _TAIL = r"len(regexp_extract_all(t, '\p{L}'))", r"len(regexp_extract_all(t, '\p{Lu}'))", r"""regexp_replace(t, '[\s"''*_)\]]+$', '')"""
_KEPT = {
    "caps": f"{_LETTERS} >= 5 and {_CAPITALS} / {_LETTERS} >= 0.9", "lowercase": f"{_LETTERS} >= 5 and {_CAPITALS} = 0", "first_word": "coalesce(w[1] = 'the', false)",
    "word": "list_contains(w, 'and')", "question_end": f"ends_with({_TAIL}, '?')", "brackets": r"regexp_full_match(trim(t), '\[[\s\S]*\]')",
}
ORACLES = {
    "check_registry": f"""
        with e as (select codes, unnest(codes) as code from ({_CODED}))
        select code, count(*) as hits, count(*) filter (codes[1] = code) as primary_hits, count(*) filter (len(codes) = 1) as only_hits from e group by code""",
    "accepted_turns": f"""
        select role, count(*) as turns, count(*) filter (len(codes) = 0) as clean,
               count(*) filter (len(list_filter(codes, lambda c: c not in ('DIGIT', 'LEN', 'NO_STOPWORD'))) = 0) as accepted from ({_CODED}) group by role""",
    "rule_predicates": f"""
        with r as (select coalesce(text, '') as t, {_W} as w from conversations where role = 'assistant')
        {" union all ".join(f"select count(*) as n, '{r}' as rule, count(*) filter ({test}) as kept from r" for r, test in _KEPT.items())}""",
    "reply_echoes": f"""
        with t as (select conv_id, turn, role, {_W} as w from conversations),
        g as (select conv_id, turn, role, unnest(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) as g from t where len(w) >= 4),
        f as (select *, min(turn) over (partition by conv_id, g) as first from g),
        s as (select conv_id, turn, round(avg(case when first < turn then 1.0 else 0.0 end), 9) as share from f where role = 'assistant' group by 1, 2)
        select *, share >= 0.8 as echo from s""",
    "turn_order": """
        with l as (select conv_id, string_agg(left(role, 1), '' order by turn) as line from conversations group by 1)
        select regexp_full_match(line, 's?(?:ua)*u?') as in_order, count(*) as conversations from l group by 1""",
    "chat_template": f"""
        with t as (select conv_id, turn, role, list_transform({_W}, lambda x: cast(length(x) + 10 as varchar) || case when role = 'assistant' then '+' else '' end) as ids from conversations),
        p as (select conv_id, turn, len(ids) + 2 as n, case when role = 'assistant' then len(ids) + 1 else 0 end as k,
                     array_to_string(list_concat([case role when 'system' then '1' when 'user' then '2' else '3' end], ids, [case when role = 'assistant' then '4+' else '4' end]), ' ') as s from t)
        select conv_id, cast(sum(n) as integer) as tokens, cast(sum(k) as integer) as targets, sha256(string_agg(s, ' ' order by turn)) as sha256 from p group by conv_id""",
    "planned_events": rf"""
        with t as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as turn, count(*) over (partition by conv_id) as n, coalesce(text, '') as text from conversations),
        v as (select *, conv_id % 6 as kind, 'Korveth ' || substr('abcde', cast(conv_id % 5 + 1 as integer), 1) as old, 'Zuldane ' || substr('abcde', cast(conv_id % 5 + 1 as integer), 1) as new from t where n >= 4),
        s as (select *, translate(text, '01234', '     ') || '. .' || case
                when turn = 0 then ' my token is ' || old || '. In the box are a stone and a feather.' || case when kind = 1 then ' Or ' || new else '' end
                when turn = 1 then ' no, it is ' || new || '.' when turn = n - 2 then case when kind = 3 then ' is it ' || new || '?' else ' what is it?' end
                when turn = n - 1 then ' it is ' || case kind when 4 then old when 5 then new || ', not ' || old else new end || ', and I count ' || case when kind = 2 then 'nine' when conv_id % 2 = 0 then 'two' else 'one' end
                when kind = 2 then ' still ' || upper(new) else '' end as said from v),
        w as (select *, ' ' || array_to_string({_W.replace("text", "said")}, ' ') || ' ' as line, {_W.replace("text", "said")} as words from s),
        h as (select *, contains(line, ' ' || lower(old) || ' ') as has_old, contains(line, ' ' || lower(new) || ' ') as has_new,
                     list_filter(list_distinct(words), lambda x: x in ('zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten')) as counts from w)
        select conv_id, null as event, turn, null::integer as held, 'VALUE_EARLY' as code from h where turn = 0 and has_new
        union all select conv_id, 'slot', turn, null, 'DIST_LEAK' from h where turn > 1 and turn < n - 2 and has_new
        union all select conv_id, 'slot', turn, null, 'QUERY_RESTATES' from h where turn = n - 2 and has_new
        union all select conv_id, 'slot', turn, null, 'ANSWER_WRONG' from h where turn = n - 1 and not has_new
        union all select conv_id, 'slot', turn, null, 'ANSWER_STALE' from h where turn = n - 1 and has_old
        union all select conv_id, 'box', turn, cast(2 - conv_id % 2 as integer), 'LIST_STATE' from h
            where turn = n - 1 and counts <> [case when conv_id % 2 = 0 then 'two' else 'one' end]""",
    "length_batches": """
        with b as (select case when n_chars <= 512 then 512 when n_chars <= 1024 then 1024 when n_chars <= 2048 then 2048 when n_chars <= 4096 then 4096 end as bucket from documents)
        select cast(bucket as integer) as bucket, count(*) as docs, coalesce(cast(ceil(count(*) / (16384 // bucket)) as bigint), 0) as batches from b group by bucket""",
    "packed_rows": """
        select case when n_chars > 8192 then 'too_long' when coalesce(n_chars, 0) < 1 then 'empty' end as reason, count(*) as docs, cast(sum(n_chars) as bigint) as chars, true as sound
        from documents group by 1""",
}
#: The same groups as those of documents, over conversations as texts.
ORACLES["near_conversations"] = (
    measures.ORACLES["minhash_groups"]
    .replace("with recursive w as", """with recursive documents as (
        select conv_id as doc_id, 'src0' as source, string_agg('role' || left(role, 1) || ' ' || coalesce(text, ''), ' ' order by turn) as text from conversations group by conv_id), w as""")
    .replace("select id as doc_id, lead", "select id as conv_id, lead")
)
QUERIES = {name: globals()[name] for name in ORACLES}
