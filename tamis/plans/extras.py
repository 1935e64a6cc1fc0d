"""Queries over stems, windows, exact limits, value drops, sentences worth keeping, word families and file checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import dates as D
from tamis.functions import grams as G
from tamis.functions import licences as L
from tamis.functions import numeric
from tamis.functions import text as T
from tamis.functions.cleaning import without_bars
from tamis.functions.stems import stems
from tamis.operators import windows
from tamis.plans import gates

#: Words that mark a user's own things and states, and words that begin a task.
OWN, STATE, TASK = r"\bmy\s+[a-z]{3,}", r"\b(?:i|we) (?:am|have|was|want|need|like|love|live|work|feel)\b", r"(?:^|[.!?]\s+|\n)(?:please )?(?:write|make|create|plan|help|give|tell|suggest)\b"
CODE, MATH = r"```|=>|</?(?:div|span|p)\b|\bpython\b|\bsql\b", r"\b(?:equation|integral|theorem|algebra)\b|[0-9]\s*[=+*]\s*[0-9]"


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stem_counts(spark, d):
    """The 100 commonest stems of English documents, with how many words share each."""
    words = _t(spark, d, "documents").where("lang = 'en'").select(T.words(F.col("text")).alias("w"))
    counted = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    stemmed = counted.select("word", "n", stems(F.array("word"))[0].alias("stem"))
    return stemmed.groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("words")).orderBy(F.desc("n"), "stem").limit(100)


def text_windows(spark, d):
    """Parts of at most 1,000 bytes of each document, and where the context of each begins."""
    return windows.text_windows(_t(spark, d, "documents"), 1000, 2000)


def chat_windows(spark, d):
    """Each assistant turn with the newest turns before it that fit into 1,500 bytes."""
    return windows.chat_windows(_t(spark, d, "conversations"), 1500)


def upper_limits(spark, d):
    """Of each source the share of poor documents among the labelled, and its exact upper limit."""
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("hits"), F.count("*").alias("n"))
    return rows.select("source", "hits", "n", F.round(numeric.upper_shares("hits", "n"), 9).alias("upper"))


def detectable_difference(spark, d):
    """Over nations the smallest difference of two priorities' mean order values that eighty of a hundred such studies would find."""
    rows = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mean = lambda p: F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))
    diff = rows.groupBy("c_nationkey").agg((mean("1-URGENT") - mean("5-LOW")).alias("d")).where("d is not null")
    whole = diff.agg(F.count("*").alias("k"), F.stddev_samp("d").alias("sd"))
    need = numeric.t_quantiles(F.lit(0.975), (F.col("k") - 1).cast("double")) + numeric.t_quantiles(F.lit(0.8), (F.col("k") - 1).cast("double"))
    return whole.select("k", F.round("sd", 3).alias("sd"), F.round(need * F.col("sd") / F.sqrt("k"), 3).alias("difference"))


def conversation_kinds(spark, d):
    """Conversations by what their user turns are about, the first that holds: code, math, personal, task, else trivia."""
    said = F.replace(F.lower(F.coalesce("text", F.lit(""))), F.lit("’"), F.lit("'"))
    users = _t(spark, d, "conversations").where("role = 'user'").select("conv_id", said.alias("t"))
    hit = lambda p: F.regexp_count("t", F.lit(p))
    by = users.groupBy("conv_id").agg(F.sum(hit(CODE)).alias("code"), F.sum(hit(MATH)).alias("math"), F.sum(hit(OWN)).alias("own"), F.sum(hit(STATE)).alias("state"), F.sum(hit(TASK)).alias("task"))
    kind = F.when(F.col("code") > 0, "code").when(F.col("math") > 0, "math").when((F.col("own") >= 1) | (F.col("state") >= 2), "personal").when(F.col("task") > 0, "task").otherwise("trivia")
    return by.groupBy(kind.alias("kind")).agg(F.count("*").alias("conversations"))


def value_drops(spark, d):
    """Part names as candidate values, by the first reason against each: form, a word of the corpus, ambiguous case, a name that others have too."""
    names = _t(spark, d, "part").select("p_partkey", F.element_at(F.split("p_name", " "), 1).alias("v"))
    words = _t(spark, d, "documents").select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("docs")).where("docs >= 3")
    twice = names.groupBy(F.lower("v").alias("low")).agg(F.countDistinct("v").alias("forms"), F.min("p_partkey").alias("first"))
    known = names.join(words, F.lower("v") == F.col("word"), "left").join(twice, F.lower("v") == F.col("low"))
    reason = F.when(~F.col("v").rlike("^[A-Za-z]{2,12}$"), "FORM").when(F.col("word").isNotNull(), "WORD_COLLISION").when(F.col("forms") > 1, "CASE_AMBIG").when(F.col("p_partkey") != F.col("first"), "DUP_NAME")
    return known.groupBy(reason.alias("reason")).agg(F.count("*").alias("names"))


def mined_sentences(spark, d):
    """Sentences of turns by the first gate that refuses them: length, dash, markup, model phrases, a benchmark's words, capitals inside."""
    parts = _t(spark, d, "conversations").select("conv_id", F.explode_outer(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+")).alias("s"))
    s = parts.select("conv_id", F.trim("s").alias("s")).where("s <> ''").withColumn("w", T.words(F.col("s")))
    held = _t(spark, d, "benchmark").select(T.words(F.col("text")).alias("w")).select(F.explode_outer(G.grams(F.col("w"), 5)).alias("g")).where("g is not null").distinct()
    runs = s.select("s", F.explode_outer(G.grams(F.col("w"), 5)).alias("g")).where("g is not null").distinct()
    leaked = runs.join(held, "g", "left_semi").select("s").distinct().withColumn("leaked", F.lit(True))
    reason = (
        F.when(~F.size("w").between(2, 25), "WORDS")
        .when(F.col("s").rlike("—|--"), "DASH")
        .when(F.col("s").rlike(r"[#*`|<>]"), "MARKUP")
        .when(G.model_phrase(F.col("s")), "AI_ISM")
        .when(F.coalesce("leaked", F.lit(False)), "HELD_OUT")
        .when(F.col("s").rlike(r"^.+\s\p{Lu}"), "CAPITAL")
    )
    return s.join(leaked, "s", "left").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("sentences"))


def word_flags(spark, d):
    """Words in ten documents or more by their flags: mostly capital inside sentences, in the benchmark, a single letter."""
    each = _t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("v"))
    by = each.groupBy(F.lower("v").alias("word")).agg(F.count("*").alias("uses"), F.count_if(F.col("v").rlike(r"^\p{Lu}")).alias("capital"), F.countDistinct("doc_id").alias("docs")).where("docs >= 10")
    held = _t(spark, d, "benchmark").select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).distinct().withColumn("held", F.lit(True))
    flags = F.array_compact(F.array(F.when((F.col("uses") >= 5) & (F.col("capital") / F.col("uses") > 0.5), "proper"), F.when(F.col("held"), "held_out"), F.when(F.length("word") == 1, "letter")))
    return by.join(held, "word", "left").select("word", "uses", F.array_join(flags, ",").alias("flags"))


def past_forms(spark, d):
    """Words of the corpus that are the regular past of another one, with its uses: by adding d, ied or ed."""
    counted = _t(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    form = F.when(F.col("word").endswith("e"), F.concat("word", F.lit("d"))).when(F.col("word").rlike("^.+[^aeiou]y$"), F.concat(F.expr("left(word, length(word) - 1)"), F.lit("ied"))).otherwise(F.concat("word", F.lit("ed")))
    base = counted.where("length(word) > 2").select(F.col("word").alias("base"), F.col("n").alias("base_uses"), form.alias("word"))
    return base.join(counted, "word").select("word", "base", "n", "base_uses")


def core_report(spark, d):
    """Documents by source and the first gate that fails: licence, written or address date, language, late text where undated, hygiene without bar lines."""
    key, text = F.col("doc_id"), without_bars(F.coalesce("text", F.lit("")))
    found = D.classified(gates.planted(gates.DATES, F.floor(key / 5)), gates._path(), "news.example", month_first=True)
    rows = _t(spark, d, "documents").select("source", "lang", L.canonical(gates.planted(gates.LICENCES[:12], key)).alias("licence"), found["status"].alias("status"), text.alias("text"))
    late = G.model_phrase(F.col("text")) | G.late_year(F.col("text"))
    reason = (
        F.when(F.col("licence").isNull(), "license")
        .when(F.col("status") == "post_cutoff", "date_gate")
        .when(F.col("status") == "unparseable", "date_unparseable")
        .when(F.coalesce(F.col("lang") != "en", F.lit(True)), "lang_field")
        .when((F.col("status") == "undated") & late, "post_cutoff_marker")
        .otherwise(F.coalesce(T.hygiene_reason(F.col("text")), F.lit("kept")))
    )
    return rows.groupBy("source", reason.alias("reason")).agg(F.count("*").alias("docs"))


def conversation_keys(spark, d):
    """Conversations by a key of their roles and folded words, quotes straight and marks gone: keys that several share."""
    straight = F.translate(F.lower(F.coalesce("text", F.lit(""))), "’‘“”", "''\"\"")
    part = F.concat(F.upper(F.left("role", F.lit(1))), F.lit(": "), F.trim(F.regexp_replace(F.regexp_replace(straight, r"[^\p{L}\p{N}\s]", " "), r"\s+", " ")))
    whole = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("body"))
    keyed = whole.groupBy(F.sha2(F.col("body").cast("binary"), 256).alias("key")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    return keyed.select("key", "n", "first")


def bank_kept(spark, d):
    """Parts as bank items of their brand: the better-judged of equal word sets stays, and how many each brand keeps."""
    sets = F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " "))), " ")
    rows = _t(spark, d, "part").select("p_brand", sets.alias("k"), F.struct((-F.col("p_size")).alias("s"), F.col("p_partkey").alias("id")).alias("rank"))
    first = rows.groupBy("p_brand", "k").agg(F.min("rank").alias("r"), F.count("*").alias("n"))
    return first.groupBy("p_brand").agg(F.count("*").alias("kept"), F.sum(F.col("n") - 1).alias("dropped"), F.min("r.id").alias("least"))


_W = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+(?:''\p{L}+)?')"
_GRAM5 = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))"
_SAID = "replace(lower(coalesce(text, '')), '’', '''')"
ORACLES = {
    "chat_windows": """
        with t as (select conv_id, turn, role, strlen(coalesce(text, '')) as n, sum(strlen(coalesce(text, ''))) over (partition by conv_id order by turn) as s from conversations),
        p as (select a.conv_id, a.turn, a.n, b.turn as first, a.s - b.s + b.n as used from t a join t b on a.conv_id = b.conv_id and b.turn <= a.turn where a.role = 'assistant')
        select conv_id, turn, min(first) filter (used <= 1500 or first = turn) as first, cast(max(used) filter (used <= 1500 or first = turn) as bigint) as bytes from p group by 1, 2""",
    "conversation_kinds": f"""
        with u as (select conv_id, {_SAID} as t from conversations where role = 'user'),
        c as (select conv_id, {", ".join(f"sum(len(regexp_extract_all(t, '{p}'))) as {n}" for n, p in (("code", CODE), ("math", MATH), ("own", OWN), ("state", STATE), ("task", TASK)))} from u group by conv_id)
        select case when code > 0 then 'code' when math > 0 then 'math' when own >= 1 or state >= 2 then 'personal' when task > 0 then 'task' else 'trivia' end as kind, count(*) as conversations from c group by 1""",
    "value_drops": f"""
        with n as (select p_partkey, split_part(p_name, ' ', 1) as v from part), w as (select word from (select unnest(list_distinct({_W})) as word from documents) group by word having count(*) >= 3),
        t as (select *, count(distinct v) over (partition by lower(v)) as forms, min(p_partkey) over (partition by lower(v)) as first from n)
        select case when not regexp_full_match(v, '[A-Za-z]{{2,12}}') then 'FORM' when lower(v) in (select word from w) then 'WORD_COLLISION' when forms > 1 then 'CASE_AMBIG'
                    when p_partkey <> first then 'DUP_NAME' end as reason, count(*) as names from t group by 1""",
    "mined_sentences": rf"""
        with s as (select trim(unnest(regexp_split_to_array(coalesce(text, ''), '[.!?\n]+'))) as s from conversations), h as (select distinct unnest({_GRAM5}) as g from (select {_W} as w from benchmark) where len(w) >= 5),
        c as (select s, {_W.replace("text", "s")} as w from s where s <> ''),
        l as (select *, len(w) >= 5 and list_has_any({_GRAM5}, (select list(g) from h)) as leaked from c)
        select case when len(w) not between 2 and 25 then 'WORDS' when regexp_matches(s, '—|--') then 'DASH' when regexp_matches(s, '[#*`|<>]') then 'MARKUP'
                    when regexp_matches(replace(lower(s), '’', ''''), '{"|".join(G.MODEL_PHRASES).replace("'", "''")}') then 'AI_ISM' when coalesce(leaked, false) then 'HELD_OUT'
                    when regexp_matches(s, '^.+\s\p{{Lu}}') then 'CAPITAL' else 'kept' end as reason, count(*) as sentences from l group by 1""",
    "word_flags": rf"""
        with e as (select doc_id, unnest(regexp_extract_all(text, '\p{{L}}+')) as v from documents),
        b as (select lower(v) as word, count(*) as uses, count(*) filter (regexp_matches(v, '^\p{{Lu}}')) as capital from e group by 1 having count(distinct doc_id) >= 10), h as (select distinct unnest({_W}) as word from benchmark)
        select word, uses, concat_ws(',', case when uses >= 5 and capital / uses > 0.5 then 'proper' end, case when word in (select word from h) then 'held_out' end, case when length(word) = 1 then 'letter' end) as flags from b""",
    "past_forms": f"""
        with c as materialized (select word, count(*) as n from (select unnest({_W}) as word from documents) group by 1),
        b as (select word as base, n as base_uses, case when ends_with(word, 'e') then word || 'd' when regexp_full_match(word, '.+[^aeiou]y') then left(word, length(word) - 1) || 'ied' else word || 'ed' end as form from c where length(word) > 2)
        select word, base, n, base_uses from b join c on form = word""",
    "core_report": f"""
        with dated as ({gates.ORACLES["written_dates"].replace(gates.written_sql(), gates.planted_sql(gates.DATES, "doc_id // 5"))}),
        c as (select doc_id, source, lang, status, {gates.planted_sql(gates.LICENCES[:12])} as lic,
                     array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: not regexp_full_match(l, '[\\s|]*\\|[\\s|]*')), chr(10)) as text from documents join dated using (doc_id))
        select source, case when ({gates._canonical("lic")}) is null then 'license' when status = 'post_cutoff' then 'date_gate' when status = 'unparseable' then 'date_unparseable'
                            when coalesce(lang <> 'en', true) then 'lang_field' when status = 'undated' and ({gates._LATE}) then 'post_cutoff_marker' else {gates._HYGIENE} end as reason, count(*) as docs from c group by all""",
    "conversation_keys": r"""
        with p as (select conv_id, turn, upper(left(role, 1)) || ': ' || trim(regexp_replace(regexp_replace(translate(lower(coalesce(text, '')), '’‘“”', '''''""'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) as p from conversations),
        b as (select conv_id, string_agg(p, chr(10) order by turn) as body from p group by 1)
        select sha256(body) as key, count(*) as n, min(conv_id) as first from b group by body""",
    "bank_kept": """
        with r as (select p_brand, p_partkey, p_size, array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' '))), ' ') as k from part),
        f as (select p_brand, k, arg_min(p_partkey, (-p_size, p_partkey)) as id, count(*) as n from r group by 1, 2)
        select p_brand, count(*) as kept, cast(sum(n - 1) as bigint) as dropped, min(id) as least from f group by 1""",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "stem_counts", "text_windows", "upper_limits", "detectable_difference")}
