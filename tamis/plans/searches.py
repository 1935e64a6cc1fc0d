"""Searches along orders, near texts, greedy banks, resampled intervals, word families, judged views and donors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.functions.text import hash_unit
from tamis.operators import families, ranges, resampling, similar
from tamis.session import Scratch


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def next_long_conversation(spark, d):
    """For each conversation the next one, from the first again after the last, whose turns hold as many bytes as this one's turns before its last."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    whole = _t(spark, d, "conversations").groupBy("conv_id").agg(F.sum(size).alias("bytes"), F.max_by(size, "turn").alias("last"))
    found = ranges.next_eligible(whole.select("conv_id", "bytes", (F.col("bytes") - F.col("last")).alias("need")), "conv_id", "bytes", "need")
    return found.select("conv_id", F.col("next").alias("donor"))


def next_long_document(spark, d):
    """For each document the next one, wrapping, of twice its characters."""
    docs = _t(spark, d, "documents").select("doc_id", "n_chars", (F.col("n_chars") * 2).alias("need"))
    return ranges.next_eligible(docs, "doc_id", "n_chars", "need").select("doc_id", F.col("next").alias("longer"))


def late_commits(spark, d):
    """Events that came after events ranked below them, and after how many; the least value ranks first."""
    counted = ranges.earlier_greater(_t(spark, d, "events"), "event_id", [F.col("ts"), F.col("event_id")], [F.col("value"), F.col("event_id")])
    return counted.where("n > 0").select("event_id", F.col("n").alias("late_after"))


def near_lines(spark, d):
    """Lines of 3 to 12 words that are one word edit apart, by their first documents; copies of a line count once."""
    # words are found where lines are split, and the explode is outer: else filters on them find them again
    worded = F.transform(F.split(F.coalesce("text", F.lit("")), "[\n.]"), lambda line: T.words(line))
    lines = _t(spark, d, "documents").select("doc_id", F.explode_outer(F.filter(worded, lambda w: F.size(w).between(3, 12))).alias("w")).where("w is not null")
    once = lines.groupBy(F.array_join("w", " ").alias("line")).agg(F.min("doc_id").alias("doc_id"))
    # keys bring their documents, so no line is looked up again
    pairs = similar.within_edits(once.select(F.struct("line", "doc_id").alias("key"), F.split("line", " ").alias("w")), "key", "w", 1)
    return pairs.select(F.col("a.line").alias("a"), F.col("b.line").alias("b"), F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), F.col("edits").cast("long").alias("edits"))


def near_replies(spark, d):
    """Assistant turns by whether they are one word edit from an earlier one of their conversation, or that one's copy with a word left out."""
    turns = _t(spark, d, "conversations").where("role = 'assistant'").withColumn("w", T.words(F.coalesce("text", F.lit(""))))
    # every second answer is followed by what a loop would make of it: the same words but the last
    again = turns.where("turn % 4 = 1").select("conv_id", (F.col("turn") + 1000).alias("turn"), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))).alias("w"))
    said = turns.select("conv_id", "turn", "w").unionByName(again).withColumn("id", F.concat_ws(":", "conv_id", "turn")).where("size(w) between 1 and 60")
    kept = Scratch(spark, "replies").keep(said, "said")
    pairs = similar.within_edits(kept, "id", "w", 1, "conv_id").where("edits = 1")
    of = lambda c: kept.select(F.col("id").alias(c), F.col("turn").alias(f"turn_{c}"), F.col("conv_id").alias(f"conv_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    late = both.select(F.col("conv_a").alias("conv_id"), F.greatest("turn_a", "turn_b").alias("turn"), F.least("turn_a", "turn_b").alias("earlier"))
    return late.groupBy("conv_id", "turn").agg(F.min("earlier").alias("earlier"))


def bank_accepted(spark, d):
    """Parts as bank items of their brand, the largest first: equal word sets fall to the first, and sets that share half of their words fall if an
    accepted one is so near. What is dropped names the accepted one."""
    sets = F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " ")))
    items = _t(spark, d, "part").select("p_partkey", "p_brand", sets.alias("w"), F.struct((-F.col("p_size")).alias("s"), F.col("p_partkey").alias("id")).alias("rank"))
    scratch = Scratch(spark, "bank")
    first = items.groupBy("p_brand", "w").agg(F.min("rank").alias("rank")).select("p_brand", "w", "rank", F.col("rank.id").alias("key"))
    once = scratch.keep(first, "once")
    links = similar.similar_sets(once, "key", "w", (1, 3), "p_brand")
    owners = similar.first_accepted(once, links, "key", "rank")
    every = items.join(once.select("p_brand", "w", "key"), ["p_brand", "w"]).join(owners, "key")
    reason = F.when(F.col("p_partkey") != F.col("key"), "DUP_EXACT").when(F.col("owner") != F.col("key"), "DUP_NEAR").otherwise("kept")
    cluster = F.when(reason == "DUP_EXACT", F.col("key")).otherwise(F.col("owner"))
    return every.select("p_partkey", reason.alias("status"), cluster.alias("cluster"))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """Scores of two arms by training seed, sampling seed, stratum and unit: shares of lines sold at a discount of 5 % or more."""
    lines = _t(spark, d, "lineitem").where("l_returnflag in ('A', 'R')").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.select(
        F.col("l_returnflag").alias("arm"), (F.col("l_orderkey") % 3).cast("int").alias("train"), (F.col("l_linenumber") % 2).cast("int").alias("seed"),
        (F.col("s_nationkey") % 3).cast("int").alias("stratum"), (F.col("l_partkey") % 7).cast("int").alias("unit"), (F.col("l_discount") >= 0.05).cast("double").alias("hit"),
    )
    return lines.groupBy("arm", "train", "seed", "stratum", "unit").agg(F.avg("hit").alias("score"))


def nested_interval(spark, d):
    """Difference of two arms with its 95 % interval: units are drawn within strata, alike for both arms, training seeds within an arm and sampling seeds
    within a drawn training seed."""
    return resampling.nested_difference(_graded(spark, d), "A", "R", 400, "nested-1")


def word_families(spark, d):
    """Words in ten documents or more with the head of their family and the rule that made them; the base of the most documents counts."""
    each = _t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    words = each.groupBy("word").agg(F.count("*").alias("docs")).where("docs >= 10")
    return families.word_families(words, "word", "docs")


def judged_view(spark, d):
    """Orders as bank items: superseded records give way to the last of their chain, copies of an earlier item are dropped before judging, and
    two verdicts of others decide. Items by bank, status and reason."""
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    # an order of an even whole price is superseded by the customer's next one
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    items = orders.select(
        F.col("o_orderkey").alias("item"), F.when(F.floor("o_totalprice") % 2 == 0, after).alias("superseded_by"), F.concat_ws(":", F.col("o_custkey") % 50, F.col("o_orderkey") % 3).alias("text"),
        F.concat("o_orderstatus", F.left("o_orderpriority", F.lit(1))).alias("bank"),
    )
    # three judges, the author among them; a judge may be missing, and a repeated verdict doesn't count
    verdict = lambda n: F.struct(F.lit(n).alias("judge"), F.when(hash_unit(F.lit(f"judge-{n}"), F.col("item")) < 0.2, "missing").when(hash_unit(F.lit(f"judge-{n}"), F.col("item")) < 0.45, "drop").otherwise("keep").alias("verdict"))
    calls = items.select("item", (F.col("item") % 3).cast("int").alias("author"), F.explode(F.array(*(verdict(n) for n in range(3)))).alias("v")).select("item", "author", "v.*").where("verdict <> 'missing' and judge <> author")
    seen = families.judged(items, calls, judged_banks="bank not like '%5'")
    return seen.groupBy("bank", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("items"), F.min("item").alias("least"), F.sum("last").alias("chain"))


def donors(spark, d):
    """Each part gets a donor of another brand for a swap test, donors used evenly."""
    return families.even_donors(_t(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand")


_UNIT = "cast(concat('0x', substr(sha256(concat_ws('|', {})), 1, 8)) as ubigint)::double / 4294967296.0"
_WORDS = r"regexp_extract_all(lower(coalesce({}, '')), '\p{{L}}+(?:''\p{{L}}+)?')"
#: Pairs one edit apart from rows l (id, w, g): a word replaced is an equal list but for one place, a word more is an equal list without one.
_ONE_EDIT = """
        m as (select id, w, g, i, array_to_string(w[1:i - 1], ' ') as head, array_to_string(w[i + 1:], ' ') as tail from (select *, unnest(range(1, len(w) + 1)) as i from l)),
        p as (select a.id as x, b.id as y from m a join m b on a.g = b.g and a.i = b.i and a.head = b.head and a.tail = b.tail and len(a.w) = len(b.w) and a.id < b.id where a.w <> b.w
              union select least(a.id, b.id), greatest(a.id, b.id) from m a join l b on a.g = b.g and len(a.w) = len(b.w) + 1 and a.w[1:a.i - 1] || a.w[a.i + 1:] = b.w)"""


def _inflection_sql() -> str:
    c, parts = families.CONSONANTS, []
    row = lambda pattern, end, rule, more="": parts.append(f"select word, docs, regexp_extract(word, '{pattern}', 1) || '{end}' as base, '{rule}' as rule from w where regexp_matches(word, '{pattern}'){more}")
    row(f"^(.+[{c}])ies$", "y", "s")
    row("^(.*(?:s|x|z|ch|sh|o))es$", "", "s")
    row("^(.*[^s])s$", "", "s")
    for e in ("ed", "ing", "er", "est"):
        row(f"^(.{{3,}}){e}$", "", e)
        row(f"^(.{{3,}}){e}$", "e", e)
        row(f"^(.{{2,}}[{c}])[{c}]{e}$", "", e, f" and substr(word, -{len(e) + 1}, 1) = substr(word, -{len(e) + 2}, 1)")
        if e != "ing":
            row(f"^(.+[{c}])i{e}$", "y", e)
    return " union all ".join(parts)


def _pick(n: str, *parts: str) -> str:
    return f"cast(least(floor(({_UNIT.format(', '.join(parts))}) * {n}), {n} - 1) as bigint)"


_VERDICTS = " union all ".join(
    f"select item, author, {n} as judge, case when u < 0.2 then 'missing' when u < 0.45 then 'drop' else 'keep' end as verdict from (select item, item % 3 as author, {_UNIT.format(f'{chr(39)}judge-{n}{chr(39)}, item')} as u from i)"
    for n in range(3)
)
ORACLES = {
    "next_long_conversation": """
        with t as (select conv_id, turn, strlen(coalesce(text, '')) as n from conversations), w as (select conv_id, sum(n) as bytes, arg_max(n, turn) as last from t group by 1)
        select a.conv_id, arg_min(b.conv_id, (b.conv_id < a.conv_id, b.conv_id)) as donor from w a left join w b on a.conv_id <> b.conv_id and b.bytes >= a.bytes - a.last group by 1""",
    "next_long_document": """
        select a.doc_id, arg_min(b.doc_id, (b.doc_id < a.doc_id, b.doc_id)) as longer from documents a
        left join documents b on a.doc_id <> b.doc_id and b.n_chars >= 2 * a.n_chars group by 1""",
    "late_commits": """
        with r as (select event_id, row_number() over (order by ts, event_id) as seq, row_number() over (order by value nulls first, event_id) as rank from events)
        select a.event_id, count(*) as late_after from r a join r b on b.seq < a.seq and b.rank > a.rank group by 1""",
    "near_lines": rf"""
        with e as (select doc_id, {_WORDS.format("line")} as w from (select doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[\n.]')) as line from documents)),
        l as (select array_to_string(w, ' ') as id, w, 0 as g, min(doc_id) as doc_id from e where len(w) between 3 and 12 group by w), {_ONE_EDIT}
        select x as a, y as b, d.doc_id as doc_a, e.doc_id as doc_b, 1::bigint as edits from p join l d on d.id = x join l e on e.id = y""",
    "near_replies": rf"""
        with t as (select conv_id, turn, {_WORDS.format("text")} as w from conversations where role = 'assistant'),
        s as (select * from t union all select conv_id, turn + 1000, w[1:greatest(len(w) - 1, 0)] from t where turn % 4 = 1),
        l as (select concat_ws(':', conv_id, turn) as id, conv_id as g, turn, w from s where len(w) between 1 and 60), {_ONE_EDIT}
        select a.g as conv_id, greatest(a.turn, b.turn) as turn, min(least(a.turn, b.turn)) as earlier from p join l a on a.id = x join l b on b.id = y group by 1, 2""",
    "bank_accepted": """
        with recursive s as (select p_partkey, p_brand, list_sort(list_distinct(string_split(lower(p_name), ' '))) as w, (-p_size, p_partkey) as r from part),
        f as (select p_brand, w, arg_min(p_partkey, r) as key, min(r) as r from s group by 1, 2),
        o as (select *, row_number() over (partition by p_brand order by r) as i from f),
        scan as (
            select p_brand, 0::bigint as i, []::struct(key bigint, w varchar[])[] as acc, null::bigint as key, null::bigint as owner from (select distinct p_brand from o)
            union all
            select p_brand, i, case when near is null then list_append(acc, {'key': key, 'w': w}) else acc end, key, coalesce(near, key)
            from (select o.p_brand, o.i, scan.acc, o.key, o.w,
                         list_filter(scan.acc, lambda a: 3 * len(list_intersect(a.w, o.w)) >= len(list_distinct(list_concat(a.w, o.w))))[1].key as near
                  from scan join o on o.p_brand = scan.p_brand and o.i = scan.i + 1))
        select s.p_partkey, case when s.p_partkey <> f.key then 'DUP_EXACT' when c.owner <> c.key then 'DUP_NEAR' else 'kept' end as status,
               case when s.p_partkey <> f.key then f.key else c.owner end as cluster
        from s join f on f.p_brand = s.p_brand and f.w = s.w join scan c on c.key = f.key""",
    "nested_interval": f"""
        with g as (
            select l_returnflag as arm, cast(l_orderkey % 3 as integer) as train, l_linenumber % 2 as seed, s_nationkey % 3 as stratum, cast(l_partkey % 7 as integer) as unit,
                   avg(case when l_discount >= 0.05 then 1.0::double else 0.0::double end) as score
            from lineitem join supplier on l_suppkey = s_suppkey where l_returnflag in ('A', 'R') group by all),
        runs as (select distinct arm, train, seed from g),
        u as (select stratum, unit, row_number() over (partition by stratum order by unit) as place, count(*) over (partition by stratum) as rows
              from (select stratum, unit from g group by 1, 2 having count(*) = (select count(*) from runs))),
        k as (select g.*, place, rows from g join u using (stratum, unit)), n as (select count(distinct stratum) as strata from u),
        m as (select arm, train, seed, sum(score / rows) / max(strata) as score from k, n group by 1, 2, 3),
        point as (select sum(s * case arm when 'A' then 100 else -100 end) as point from (select arm, avg(s) as s from (select arm, train, avg(score) as s from m group by 1, 2) group by 1)),
        r as (select unnest(range(400)) as replicate),
        uw as (select replicate, stratum, place, count(*) / max(rows) as weight
               from (select replicate, stratum, rows, {_pick("rows", "'nested-1'", "replicate", "stratum", "place")} + 1 as place from u, r) group by 1, 2, 3),
        s as (select arm, train, list(seed order by seed) as seeds from runs group by 1, 2), t as (select arm, list(train order by train) as trains from s group by 1),
        d as (select replicate, arm, slot, trains[1 + {_pick("len(trains)", "'nested-1'", "replicate", "arm", "slot")}] as train from (select *, unnest(range(len(trains))) as slot from t, r)),
        e as (select replicate, arm, train, seeds[1 + {_pick("len(seeds)", "'nested-1'", "replicate", "arm", "slot", "k")}] as seed from (select d.*, seeds, unnest(range(len(seeds))) as k from d join s using (arm, train))),
        rw as (select replicate, arm, train, seed, count(*) / sum(count(*)) over (partition by replicate, arm) as weight from e group by 1, 2, 3, 4),
        br as (select replicate, arm, train, seed, sum(weight * score) / max(strata) as score from uw join k using (stratum, place), n group by 1, 2, 3, 4),
        gaps as (select round(sum(rw.weight * br.score * case arm when 'A' then 100 else -100 end), 9) as gap from br join rw using (replicate, arm, train, seed) group by replicate),
        l as (select list(gap order by gap) as gaps from gaps)
        select (select count(*) from u) as units, round(point, 9) as point, gaps[11] as low, gaps[391] as high from l, point""",
    "word_families": rf"""
        with recursive w as (select word, count(*) as docs from (select unnest(list_distinct({_WORDS.format("text")})) as word from documents) group by 1 having count(*) >= 10),
        c as ({_inflection_sql()}),
        b as (select c.word, arg_min({{'base': base, 'rule': rule}}, (-x.docs, base, rule)) as b from c join w x on x.word = base where length(base) >= 3 and x.docs * 10 >= c.docs group by 1),
        chain as (select word, word as spot, 0 as steps from w union all select chain.word, b.b.base, steps + 1 from chain join b on b.word = chain.spot),
        heads as (select word, arg_max(spot, steps) as head from chain group by 1)
        select word, head, b.b.base as base, b.b.rule as rule from heads left join b using (word)""",
    "judged_view": f"""
        with recursive i as (
            select o_orderkey as item, case when floor(o_totalprice) % 2 = 0 then lead(o_orderkey) over (partition by o_custkey order by o_orderkey) end as superseded_by,
                   concat_ws(':', o_custkey % 50, o_orderkey % 3) as text, o_orderstatus || left(o_orderpriority, 1) as bank from orders),
        chain as (select item, superseded_by as spot, 1 as steps from i where superseded_by is not null
                  union all select chain.item, i.superseded_by, steps + 1 from chain join i on i.item = chain.spot where i.superseded_by is not null),
        ends as (select item, arg_max(spot, steps) as last from chain group by 1),
        v as (select item, count(*) filter (verdict = 'keep') as keeps, count(*) filter (verdict = 'drop') as drops from ({_VERDICTS}) where verdict <> 'missing' and judge <> author group by 1),
        x as (select i.*, coalesce(last, item) as last, coalesce(keeps, 0) as keeps, coalesce(drops, 0) as drops,
                     case when superseded_by is null then min(case when superseded_by is null then item end) over (partition by bank, text) end as first
              from i left join ends using (item) left join v using (item)),
        s as (select *, case when superseded_by is not null then 'SUPERSEDED' when first <> item then 'DUP_EXACT' when bank like '%5' then '' when drops > 0 then 'JUDGE_DROP' when keeps < 2 then 'JUDGE_MISSING' else '' end as reason from x)
        select bank, case reason when '' then 'kept' when 'JUDGE_MISSING' then 'pending' else 'dropped' end as status, reason, count(*) as items, min(item) as least, cast(sum(last) as bigint) as chain
        from s group by all""",
    "donors": """
        with p as (select p_partkey, row_number() over (order by p_brand, p_partkey) - 1 as place, count(*) over () as n from part),
        m as (select max(n) as most from (select count(*) as n from part group by p_brand))
        select a.p_partkey, b.p_partkey as donor from p a, m join p b on b.place = (a.place + most) % a.n""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
