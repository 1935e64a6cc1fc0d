"""Queries over paragraphs of scans and logs, over values in texts, and over twin and paired rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.operators import books

VALUES = {"the": "article", "and": "joint", "Der": "article"}


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _known(spark, d) -> DataFrame:
    """Plain words in at least five documents."""
    each = _t(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("docs")).where("docs >= 5").select("word")


def _parts(spark, d) -> DataFrame:
    """Documents as books whose lines are paragraphs; every seventh has junk planted in its lines."""
    dirty = F.when(F.col("doc_id") % 7 == 3, F.replace("text", F.lit("\n"), F.lit(" ~^{}|\n"))).otherwise(F.col("text"))
    return books.paragraphs(_t(spark, d, "documents").select("doc_id", dirty.alias("text")), "\n")


def scan_paragraphs(spark, d):
    """Paragraphs and bytes by the reason why they read as scanning junk."""
    rows = books.paragraph_reasons(_parts(spark, d), _known(spark, d))
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("paragraphs"), F.sum(F.octet_length("p")).cast("long").alias("bytes"))


def scan_books(spark, d):
    """Books by whether what is left of them is enough."""
    return books.book_reasons(_parts(spark, d), _known(spark, d))


def end_matter(spark, d):
    """Front and back paragraphs that name a licence or a version, and the bytes without them."""
    is_matter = lambda p: F.lower(p).rlike("licen|version|copyright|produced by|[0-9]{4}")
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", "text", books.matter_places(F.col("text"), is_matter, "\n").alias("places"))
    return docs.select("doc_id", F.size("places").alias("dropped"), F.octet_length(books.without_places(F.col("text"), F.col("places"), "\n")).alias("bytes"))


def masked_texts(spark, d):
    """The hash of each document with values masked by their type."""
    return _t(spark, d, "documents").select("doc_id", F.sha1(books.masked(F.col("text"), VALUES).cast("binary")).alias("sha1"))


def span_counts(spark, d):
    """Places of each type of value, and their first and last start."""
    spans = _t(spark, d, "documents").select("doc_id", F.explode(books.value_spans(F.col("text"), VALUES)).alias("s"))
    return spans.groupBy("s.type").agg(F.count("*").alias("n"), F.sum("s.start").alias("starts"))


def relabelled_logs(spark, d):
    """Conversations as logs with planted speakers, relabelled: lines and speakers of each."""
    line = F.concat(F.lit("[10:0"), (F.col("turn") % 10).cast("string"), F.lit("] <nick_"), "role", F.lit("> nick_user said "), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "))
    logs = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("log"))
    clean = books.relabelled_logs(logs, "conv_id", "log").select("conv_id", F.explode(F.split("log", "\n")).alias("l"))
    return clean.groupBy("conv_id").agg(F.count("*").alias("lines"), F.countDistinct(F.regexp_extract("l", r"^(P[0-9]+): ", 1)).alias("speakers"), F.count_if(F.contains("l", F.lit("nick_user"))).alias("named"))


def compressed_roles(spark, d):
    """Compressed over raw bytes of each role's turns."""
    turns = _t(spark, d, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "text")
    return books.compressed_shares(turns, "role", "at", "text")


def twin_rows(spark, d):
    """Own rows with their twin of the same responder and render: twins, and those right on both sides."""
    rows = _t(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 2).alias("id"), (F.col("o_orderkey") % 2 == 1).alias("twin"), (F.col("o_custkey") % 3).alias("responder"), F.col("o_orderpriority").alias("render"), (F.col("o_orderstatus") == "F").alias("ok"))
    own, other = rows.where("not twin"), rows.where("twin").select("id", "responder", "render", F.col("ok").alias("other"))
    both = own.join(other, ["id", "responder", "render"], "left")
    return both.groupBy("responder").agg(F.count("*").alias("own"), F.count("other").alias("twins"), F.count_if(F.col("ok") & F.col("other")).alias("both_right"))


def exact_pairs(spark, d):
    """Orders of exactly two lines as pairs: whether both were sent back, and how many orders have another number."""
    by = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.every(F.col("l_returnflag") == "R").alias("all_back"))
    return by.groupBy((F.col("n") == 2).alias("pair"), (F.col("all_back") & (F.col("n") == 2)).alias("both_back")).agg(F.count("*").alias("orders"))


def word_classes(spark, d):
    """A proxy of each word's class by what stands before it, at rates against all words; unk where there is too little."""
    worded = _t(spark, d, "documents").where("lang = 'en'").select(T.words(F.col("text")).alias("w"))
    pairs = worded.select(F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.struct(F.try_element_at("w", i).alias("a"), F.try_element_at("w", i + 1).alias("b")))).alias("p")).where("p.b is not null")
    kinds = {"noun": F.col("p.a").isin("the", "a", "an"), "verb": F.col("p.a").isin("to", "they", "he", "she", "it"), "adj": F.col("p.a").isin("is", "are", "was", "so")}
    by = pairs.groupBy(F.col("p.b").alias("word")).agg(F.count("*").alias("tf"), *(F.count_if(c).alias(k) for k, c in kinds.items())).where("tf >= 5")
    total = by.agg(*(F.greatest(F.sum(k), F.lit(1)).alias(k) for k in kinds)).head()
    best = F.greatest(*(F.struct(F.round(F.col(k) / F.lit(total[k] or 1), 12).alias("rate"), F.lit(k).alias("kind")) for k in kinds))
    enough = sum((F.col(k) for k in kinds), F.lit(0)) >= F.greatest(F.lit(3), F.lit(0.05) * F.col("tf"))
    return by.select("word", "tf", F.when(enough, best["kind"]).otherwise("unk").alias("kind"))


_LINES = r"""select doc_id, unnest(string_split(t, chr(10))) as p, unnest(range(len(string_split(t, chr(10))))) as place
    from (select doc_id, case when doc_id % 7 = 3 then replace(text, chr(10), ' ~^{}|' || chr(10)) else text end as t from documents)"""
_KNOWN = "select word from (select unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}'))) as word from documents) group by word having count(*) >= 5"
_SET = books._SET.replace("'", "''")
_PARTS = rf"""
    with known as ({_KNOWN}), l as ({_LINES}),
    r as (select *, list_filter(string_split(regexp_replace(p, '[\s\p{{Z}}]+', ' ', 'g'), ' '), lambda x: x <> '') as toks, regexp_extract_all(lower(p), '[a-z]{{2,}}') as lw,
                 len(regexp_extract_all(p, '[^\p{{L}}\p{{N}}_\s\p{{Z}}{_SET}]')) as junk, length(regexp_replace(p, '[\s\p{{Z}}]', '', 'g')) as solid from l),
    w as (select doc_id, place, unnest(lw) as word from r), k as (select doc_id, place, count(*) filter (word in (select word from known)) / count(*) as dict,
          bool_or(length(word) >= 3 and word in (select word from known)) as long from w group by all),
    c as (select r.*, coalesce(dict, 0) as dict, coalesce(long, false) as long, len(list_filter(list_transform(toks, lambda x: regexp_replace(x, '^[{_SET}_ ]+|[{_SET}_ ]+$', '', 'g')),
            lambda u: u <> '' and not regexp_full_match(u, '\p{{Nd}}+') and not regexp_matches(u, '\p{{L}}{{2}}') and lower(u) not in ('a', 'i', 'o'))) as bare from r left join k using (doc_id, place)),
    e as (select *, case when case when solid > 0 then junk / solid else 1.0 end > 0.02 then 'ocr_junk_symbols' when case when len(toks) > 0 then bare / len(toks) else 1.0 end > 0.40 then 'ocr_fragments'
            when len(toks) < 8 and not long then 'ocr_no_word' when len(toks) >= 8 and dict < 0.50 then 'ocr_nonwords' end as reason from c)"""
ORACLES = {
    "scan_paragraphs": f"{_PARTS} select coalesce(reason, 'kept') as reason, count(*) as paragraphs, cast(sum(strlen(p)) as bigint) as bytes from e group by 1",
    "scan_books": rf"""{_PARTS},
        b as (select doc_id, cast(sum(len(regexp_extract_all(p, '\p{{L}}'))) as bigint) as letters_in,
                     cast(coalesce(sum(len(regexp_extract_all(p, '\p{{L}}'))) filter (reason is null), 0) as bigint) as letters_kept from e group by doc_id),
        kw as (select doc_id, unnest(lw) as word from e where reason is null), s as (select doc_id, count(*) filter (word in (select word from known)) / count(*) as rate from kw group by doc_id)
        select doc_id, letters_in, letters_kept, case when letters_in > 0 and letters_kept < 0.5 * letters_in then 'ocr_mostly_junk' when coalesce(rate, 0) < 0.75 then 'ocr_low_words' end as reason
        from b left join s using (doc_id)""",
    "relabelled_logs": """
        with c as (select conv_id, count(*) as n, count(*) filter (role = 'user') as users, count(distinct role) as speakers,
                          sum(1 + len(regexp_extract_all(lower(coalesce(text, '')), 'nick_user'))) as said from conversations group by 1)
        select conv_id, n as lines, speakers, case when users = 0 or said > 3 * users + 5 then n else 0 end as named from c""",
    "twin_rows": """
        with r as (select o_orderkey // 2 as id, o_orderkey % 2 = 1 as twin, o_custkey % 3 as responder, o_orderpriority as render, o_orderstatus = 'F' as ok from orders)
        select a.responder, count(*) as own, count(b.id) as twins, count(*) filter (a.ok and b.ok) as both_right from (select * from r where not twin) a
        left join (select * from r where twin) b on a.id = b.id and a.responder = b.responder and a.render = b.render group by 1""",
    "exact_pairs": """
        with b as (select l_orderkey, count(*) as n, bool_and(l_returnflag = 'R') as back from lineitem group by 1)
        select n = 2 as pair, back and n = 2 as both_back, count(*) as orders from b group by all""",
    "word_classes": r"""
        with d as (select regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?') as w from documents where lang = 'en'),
        p as (select unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i + 1]})) as p from d),
        b as (select p.b as word, count(*) as tf, count(*) filter (p.a in ('the', 'a', 'an')) as noun, count(*) filter (p.a in ('to', 'they', 'he', 'she', 'it')) as verb,
                     count(*) filter (p.a in ('is', 'are', 'was', 'so')) as adj from p group by 1 having count(*) >= 5),
        r as (select *, round(noun / greatest(sum(noun) over (), 1), 12) as rn, round(verb / greatest(sum(verb) over (), 1), 12) as rv, round(adj / greatest(sum(adj) over (), 1), 12) as ra from b)
        select word, tf, case when noun + verb + adj < greatest(3, 0.05 * tf) then 'unk' when rv >= rn and rv >= ra then 'verb' when rn >= ra then 'noun' else 'adj' end as kind from r""",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "end_matter", "masked_texts", "span_counts", "compressed_roles")}
