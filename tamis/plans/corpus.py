"""Queries over texts: gates, deduplication, statistics, sampling and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamis.functions import grams as G
from tamis.functions import text as T
from tamis.operators import dedup, sampling
from tamis.session import Scratch

_STOP = "'" + "', '".join(w.replace("'", "''") for w in T.STOPWORDS.split()) + "'"
_WORDS = r"regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?')"
_REASON = rf"""
    select *, case
        when coalesce(text, '') = '' then 'empty'
        when strlen(text) < 200 then 'too_short'
        when letters > 0 and (letters - plain) / letters > 0.30 then 'non_ascii'
        when len(words) = 0 or len(list_filter(words, lambda w: w in ({_STOP}))) / len(words) < 0.10 then 'not_english'
        else 'kept' end as reason
    from (select *, {_WORDS} as words,
            len(regexp_extract_all(text, '\p{{L}}')) as letters,
            len(regexp_extract_all(text, '[A-Za-z]')) as plain from documents)"""
_UNIT = "cast(concat('0x', substr(sha256(concat_ws('|', {})), 1, 8)) as ubigint)::double / 4294967296.0"
_LINES = "select doc_id, trim(l) as line from (select doc_id, unnest(string_split(text, chr(10))) as l from documents) where trim(l) <> ''"


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(*columns)


def yield_report(spark, d):
    """Documents and bytes by source and first failing gate."""
    docs = _docs(spark, d, "source", "text").withColumn("reason", F.coalesce(T.hygiene_reason(F.col("text")), F.lit("kept")))
    return docs.groupBy("source", "reason").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def hygiene_gates(spark, d):
    return _docs(spark, d, "doc_id", "text").select("doc_id", F.coalesce(T.hygiene_reason(F.col("text")), F.lit("kept")).alias("reason"))


def exact_dedup(spark, d):
    """Kept documents: the first of each text by source number, then id."""
    docs = _docs(spark, d, "doc_id", "source", "text").withColumn("rank", F.regexp_extract("source", "[0-9]+", 0).cast("int"))
    return dedup.first_by(docs, F.sha2(F.col("text").cast("binary"), 256), ["rank", "doc_id"], ["rank", "doc_id", "source"]).drop("rank")


def frequent_lines(spark, d):
    return dedup.frequent_lines(_docs(spark, d, "doc_id", "text"), 3)


def boilerplate_strip(spark, d):
    docs = _docs(spark, d, "doc_id", "text")
    return dedup.drop_lines(docs, dedup.frequent_lines(docs, 3))


def paragraph_dedup(spark, d):
    """Lines of ten words or more that another document has before: how many a document loses. Repeats inside a document stay."""
    lines = dedup.lines_of(_docs(spark, d, "doc_id", "text")).where(F.size(F.split("line", " ")) >= 10)
    each = lines.groupBy("doc_id", F.sha2(F.col("line").cast("binary"), 256).alias("h")).agg(F.count("*").alias("n"))
    first = each.groupBy("h").agg(F.min("doc_id").alias("owner"))
    lost = each.join(first, "h").where("doc_id <> owner")
    return lost.groupBy("doc_id").agg(F.sum("n").alias("dropped"))


def document_frequency(spark, d):
    """Words in at least 5 documents of at least 2 sources."""
    each = _docs(spark, d, "doc_id", "source", "text").select("source", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    by_source = each.groupBy("word", "source").agg(F.count("*").alias("n"))
    return by_source.groupBy("word").agg(F.sum("n").alias("docs"), F.count("*").alias("sources")).where("docs >= 5 and sources >= 2")


def word_table(spark, d):
    """Term and document frequency by language."""
    each = _docs(spark, d, "doc_id", "lang", "text").select("doc_id", "lang", F.explode(T.words(F.col("text"))).alias("word"))
    per_doc = each.groupBy("lang", "word", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("lang", "word").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def word_score(spark, d):
    """Geometric mean over languages of a word's document share (at least half a document), for words in 3 languages."""
    docs = _docs(spark, d, "lang", "text")
    size = docs.groupBy("lang").agg(F.count("*").alias("docs"))
    df = docs.select("lang", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).groupBy("word", "lang").agg(F.count("*").alias("df"))
    wide = df.join(F.broadcast(size), "lang")
    score = F.round(F.exp(F.avg(F.log(F.greatest(F.col("df"), F.lit(0.5)) / F.col("docs")))), 9)
    return wide.groupBy("word").agg(F.count("*").alias("langs"), score.alias("score")).where("langs >= 3")


def distinct_n(spark, d):
    """Distinct word pairs over all word pairs, by role."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("role", T.words(F.col("text")).alias("w"))
    pairs = turns.select("role", F.explode_outer(G.grams(F.col("w"), 2)).alias("pair")).where("pair is not null")
    counted = pairs.groupBy("role", "pair").agg(F.count("*").alias("n"))
    return counted.groupBy("role").agg(F.count("*").alias("distinct_pairs"), F.sum("n").alias("pairs")).withColumn("share", F.round(F.col("distinct_pairs") / F.col("pairs"), 9))


def length_histogram(spark, d):
    """Documents by half-open length bins; empty bins are listed, texts beyond the last one are in none."""
    bins = spark.createDataFrame([(0, 500), (500, 1000), (1000, 2000), (2000, 5000), (5000, 10000), (10000, 1000000)], "low int, high int")
    at = F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") < 1000, 500).when(F.col("n_chars") < 2000, 1000).when(F.col("n_chars") < 5000, 2000).when(F.col("n_chars") < 10000, 5000).when(F.col("n_chars") < 1000000, 10000)
    counts = _docs(spark, d, "n_chars").groupBy(at.alias("low")).agg(F.count("*").alias("n"))
    return bins.join(counts, "low", "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def hash_split(spark, d):
    return sampling.hash_split(_docs(spark, d, "doc_id", "source"), F.concat_ws(":", "source", F.col("doc_id").cast("string")), "split-1", 0.1)


def holdout_exclusion(spark, d):
    """Documents whose text isn't the text of a held-out document."""
    docs = _docs(spark, d, "doc_id", "source", "text").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    split = sampling.hash_split(docs, F.col("doc_id").cast("string"), "split-2", 0.2)
    out = split.where("held_out").select(F.col("h")).distinct()
    return split.where("not held_out").join(out, "h", "left_anti").select("doc_id", "source")


def seeded_sample(spark, d):
    return sampling.seeded_limit(_docs(spark, d, "doc_id", "source"), "source", "doc_id", "sample-1", 5)


def closest_prefix(spark, d):
    return sampling.closest_prefix(_docs(spark, d, "doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 20000.0)


def bytes_per_word(spark, d):
    """Bytes over words by source, and over all."""
    docs = _docs(spark, d, "source", "text").select("source", F.octet_length("text").alias("b"), F.size(T.words(F.col("text"))).alias("w"))
    total = docs.rollup("source").agg(F.sum("b").cast("long").alias("bytes"), F.sum("w").cast("long").alias("words"))
    return total.select(F.coalesce("source", F.lit("ALL")).alias("source"), "bytes", "words", F.round(F.col("bytes") / F.col("words"), 9).alias("ratio"))


def overlap_measure(spark, d):
    """13-word windows of the benchmark that documents hold: documents and windows by item. Windows of documents are made distinct after the join, which
    leaves almost none; the benchmark's are a written table, so that Spark knows its size and broadcasts it if it is small."""
    def windows(rows: DataFrame, key: str) -> DataFrame:
        w = rows.select(key, T.words(F.col("text")).alias("w"))
        at = w.select(key, F.explode_outer(G.grams(F.col("w"), 13)).alias("g")).where("g is not null")
        return at.select(key, F.xxhash64("g").alias("h"), "g")

    bench = Scratch(spark, "overlap").keep(windows(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id").distinct(), "windows")
    hits = windows(_docs(spark, d, "doc_id", "text"), "doc_id").join(bench, ["h", "g"])
    return hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("g").alias("windows"))


def previous_turn(spark, d):
    """Whether a turn repeats the one before, and the share of its words that the one before has."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    own, old = F.array_distinct(T.words(F.col("text"))), F.array_distinct(T.words(F.col("before")))
    share = F.when(F.size(own) > 0, F.size(F.array_intersect(own, old)) / F.size(own)).otherwise(F.lit(0.0))
    return turns.withColumn("before", before).where("before is not null").select("conv_id", "turn", (F.col("text") == F.col("before")).alias("copied"), F.round(share, 9).alias("share"))


def url_groups(spark, d):
    """Pages by host: pages and distinct address keys without their query."""
    key = T.url_key(F.regexp_replace("url", r"\?.*$", ""))
    pages = spark.read.parquet(f"{d}/pages.parquet").select(key.alias("key"))
    return pages.groupBy(F.regexp_extract("key", "^[^/]*", 0).alias("host")).agg(F.count("*").alias("pages"), F.countDistinct("key").alias("keys"))


def length_buckets(spark, d):
    """Documents in the smallest bucket that holds them; longer ones in none (-1)."""
    bucket = F.coalesce(*(F.when(F.col("n_chars") <= b, F.lit(b)) for b in (256, 512, 1024, 2048, 4096, 8192)), F.lit(-1))
    return _docs(spark, d, "n_chars").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


def vote_winner(spark, d):
    """Vote over an order's first lines' ship years: the most common of at least two equal votes, of ties the latest year."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber <= 3").select("l_orderkey", F.year("l_shipdate").alias("vote"))
    counted = lines.groupBy("l_orderkey", "vote").agg(F.count("*").alias("n")).where("n >= 2")
    return counted.groupBy("l_orderkey").agg(F.max(F.struct("n", "vote"))["vote"].alias("winner"))


def frame_cap(spark, d):
    """Within each source and length class, the share cap keeps max(2, a twentieth of the rows), longest first."""
    docs = _docs(spark, d, "doc_id", "source", "n_chars")
    kept = sampling.first_share(docs, "source", [F.desc("n_chars"), F.col("doc_id")], 0.05, 2)
    return kept.select("doc_id", "source", F.col("place").cast("int").alias("place"))


_SHA = "sha256(text)"
ORACLES = {
    "yield_report": f"select source, reason, count(*) as docs, cast(sum(strlen(text)) as bigint) as bytes from ({_REASON}) group by all",
    "hygiene_gates": f"select doc_id, reason from ({_REASON})",
    "exact_dedup": f"select doc_id, source from documents qualify row_number() over (partition by {_SHA} order by cast(regexp_extract(source, '[0-9]+') as int), doc_id) = 1",
    "frequent_lines": f"select sha256(line) as line_hash, count(distinct doc_id) as docs from ({_LINES}) group by 1 having count(distinct doc_id) >= 3",
    "boilerplate_strip": f"""
        with l as ({_LINES}), bad as (select line from l group by line having count(distinct doc_id) >= 3),
        c as (select doc_id, count(*) as n, count(*) filter (line in (select line from bad)) as bad from l group by doc_id)
        select doc_id, coalesce(n - bad, 0) as kept_lines, coalesce(bad, 0) as dropped_lines from documents left join c using (doc_id)""",
    "paragraph_dedup": f"""
        with l as (select doc_id, line, min(doc_id) over (partition by line) as owner from ({_LINES}) where len(string_split(line, ' ')) >= 10)
        select doc_id, count(*) as dropped from l where doc_id <> owner group by doc_id""",
    "document_frequency": r"""
        with w as (select source, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?'))) as word from documents)
        select word, count(*) as docs, count(distinct source) as sources from w group by word having count(*) >= 5 and count(distinct source) >= 2""",
    "word_table": r"""
        with w as (select doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?')) as word from documents)
        select lang, word, count(*) as tf, count(distinct doc_id) as df from w group by lang, word""",
    "word_score": r"""
        with w as (select lang, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?'))) as word from documents),
        s as (select lang, count(*) as docs from documents group by lang), f as (select word, lang, count(*) as df from w group by all)
        select word, count(*) as langs, round(exp(avg(ln(greatest(df, 0.5) / docs))), 9) as score from f join s using (lang) group by word having count(*) >= 3""",
    "distinct_n": r"""
        with t as (select role, regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?') as w from conversations),
        p as (select role, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as pair from t where len(w) > 1)
        select role, count(distinct pair) as distinct_pairs, count(*) as pairs, round(count(distinct pair) / count(*), 9) as share from p group by role""",
    "length_histogram": """
        with b(low, high) as (values (0, 500), (500, 1000), (1000, 2000), (2000, 5000), (5000, 10000), (10000, 1000000))
        select low, high, count(n_chars) as n from b left join documents on n_chars >= low and n_chars < high group by low, high""",
    "hash_split": f"select doc_id, source, {_UNIT.format(chr(39) + 'split-1' + chr(39) + ', source || ' + chr(39) + ':' + chr(39) + ' || doc_id')} < 0.1 as held_out from documents",
    "holdout_exclusion": f"""
        with s as (select doc_id, source, text, {_UNIT.format("'split-2', cast(doc_id as varchar)")} < 0.2 as held_out from documents)
        select doc_id, source from s where not held_out and text not in (select text from s where held_out)""",
    "seeded_sample": """
        select doc_id, source, cast(row_number() over (partition by source order by sha256('sample-1|' || doc_id), doc_id) as integer) as rank
        from documents qualify rank <= 5""",
    "closest_prefix": """
        with r as (select source, sum(n_chars) over w as total, count(*) over w as rows from documents
                   window w as (partition by source order by doc_id rows unbounded preceding))
        select source, rows, cast(total as bigint) as total from r qualify row_number() over (partition by source order by abs(total - 20000), rows) = 1""",
    "bytes_per_word": r"""
        with c as (select source, strlen(text) as b, len(regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?')) as w from documents)
        select coalesce(source, 'ALL') as source, cast(sum(b) as bigint) as bytes, cast(sum(w) as bigint) as words, round(sum(b) / sum(w), 9) as ratio from c group by rollup (source)""",
    "overlap_measure": r"""
        with b as (select item_id, regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?') as w from benchmark),
        d as (select doc_id, regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?') as w from documents),
        bg as (select distinct item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as g from b where len(w) >= 13),
        dg as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as g from d where len(w) >= 13)
        select item_id, count(distinct doc_id) as docs, count(distinct g) as windows from bg join dg using (g) group by item_id""",
    "previous_turn": r"""
        with t as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as before from conversations),
        w as (select *, list_distinct(regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?')) as own,
                     list_distinct(regexp_extract_all(lower(before), '\p{L}+(?:''\p{L}+)?')) as old from t where before is not null)
        select conv_id, turn, text = before as copied, round(case when len(own) > 0 then len(list_intersect(own, old)) / len(own) else 0 end, 9) as share from w""",
    "url_groups": r"""
        with k as (select regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '\?.*$', '')), '^[a-z]+://', ''), '^www\.', ''), '#.*$', ''), '/+$', '') as key from pages)
        select regexp_extract(key, '^[^/]*') as host, count(*) as pages, count(distinct key) as keys from k group by 1""",
    "length_buckets": """
        select case when n_chars <= 256 then 256 when n_chars <= 512 then 512 when n_chars <= 1024 then 1024 when n_chars <= 2048 then 2048
                    when n_chars <= 4096 then 4096 when n_chars <= 8192 then 8192 else -1 end as bucket, count(*) as docs, cast(sum(n_chars) as bigint) as chars
        from documents group by 1""",
    "vote_winner": """
        select l_orderkey, year(l_shipdate) as winner from lineitem where l_linenumber <= 3 group by 1, 2 having count(*) >= 2
        qualify row_number() over (partition by l_orderkey order by count(*) desc, year(l_shipdate) desc) = 1""",
    "frame_cap": """
        with r as (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) as place,
                          greatest(2, floor(count(*) over (partition by source) * 0.05)) as cap from documents)
        select doc_id, source, cast(place as integer) as place from r where place <= cap""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
