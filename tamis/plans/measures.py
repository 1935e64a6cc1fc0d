"""Measures and audits: late text, reserves, window exports, experiment statistics and constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import grams as G
from tamis.functions import text as T
from tamis.functions.html import html_text
from tamis.operators import minhash, ordered, phrases
from tamis.session import Scratch
from tamis.sources import jsonl, ranges
from tamis.streaming import events as stream
from tamis.streaming import jobs


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _grams(rows: DataFrame, n: int, key: str) -> DataFrame:
    """(key, g) of every run of n words. Words are a column of their own, and the explode an outer one: else Spark repeats the
    regular expression inside the lambda, or in a filter on the array's size, once for each word."""
    worded = rows.select(key, T.words(F.col("text")).alias("w"))
    return worded.select(key, F.explode_outer(G.grams(F.col("w"), n)).alias("g")).where("g is not null")


def late_text(spark, d):
    """Documents by source with a model phrase, and with a year after the cutoff."""
    docs = _t(spark, d, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(G.model_phrase(F.col("text"))).alias("model_phrases"), F.count_if(G.late_year(F.col("text"))).alias("late_years"))


def reserve_holdout(spark, d):
    return _t(spark, d, "documents").select("doc_id", G.in_reserve("reserve-1:", F.col("doc_id")).alias("reserved"))


def window_hashes(spark, d):
    """The distinct SHA-256 of every 13 neighbouring benchmark words, by items that have it: a list that can be shared without the texts."""
    runs = _grams(_t(spark, d, "benchmark"), 13, "item_id")
    return runs.groupBy(F.sha2(F.col("g").cast("binary"), 256).alias("sha256")).agg(F.countDistinct("item_id").alias("items"))


def word_pairs(spark, d):
    """The 100 commonest pairs of neighbouring words by documents, ties by the pair."""
    return phrases.heaviest(_t(spark, d, "documents"), (2,), 100, by_text=True).select(F.col("phrase").alias("pair"), F.col("n").alias("docs"))


def top_word_overlap(spark, d):
    """For each two languages, the Jaccard similarity of their 50 commonest words."""
    each = _t(spark, d, "documents").select("lang", F.explode(T.words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = each.withColumn("place", place).where("place <= 50").select("lang", "word")
    size = top.groupBy("lang").agg(F.count("*").alias("size"))
    left, right = top.select(F.col("lang").alias("a"), "word"), top.select(F.col("lang").alias("b"), "word")
    both = left.join(right, "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = both.join(size.select(F.col("lang").alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col("lang").alias("b"), F.col("size").alias("nb")), "b")
    return sized.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 9).alias("jaccard"))


def subsample(spark, d):
    """The 100 documents with the least hash: a sample that stays the same when rows move."""
    order = F.substring(F.sha2(F.concat(F.lit("sub-1:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8)
    return _t(spark, d, "documents").select("doc_id", order.alias("rank")).orderBy("rank", "doc_id").limit(100)


def holm_step_down(spark, d):
    """Nations whose share of finished orders holds as a p value under Holm's rule: the i-th least of m is at most 0.5 / (m - i)."""
    orders = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = orders.groupBy("c_nationkey").agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")) / 20, 9).alias("p"))
    ordered = Window.orderBy("p", "c_nationkey")  # one row for each nation
    ranked = p.withColumn("i", F.row_number().over(ordered)).withColumn("m", F.count("*").over(Window.partitionBy()))
    ok = F.col("p") <= F.lit(0.5) / (F.col("m") - F.col("i") + 1)
    return ranked.withColumn("ok", ok).select("c_nationkey", "p", F.every("ok").over(ordered).alias("holds"))


def paired_difference(spark, d):
    """Over nations, the mean order value of urgent less low orders: pairs, mean, standard deviation and t."""
    orders = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mean = lambda x: F.avg(F.when(F.col("o_orderpriority") == x, F.col("o_totalprice")))
    pairs = orders.groupBy("c_nationkey").agg((mean("1-URGENT") - mean("5-LOW")).alias("diff")).where("diff is not null")
    whole = pairs.agg(F.count("*").alias("pairs"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"))
    return whole.select("pairs", F.round("mean", 3).alias("mean"), F.round("sd", 3).alias("sd"), F.round(F.col("mean") / (F.col("sd") / F.sqrt("pairs")), 6).alias("t"))


def pooled_deviation(spark, d):
    """Within-nation standard deviation of order value, pooled: squared residuals over the degrees of freedom."""
    orders = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    arms = orders.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.var_samp("o_totalprice").alias("v")).where("n > 1")
    return arms.agg(F.sum(F.col("n") - 1).alias("freedom"), F.round(F.sqrt(F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)), 3).alias("sd"))


def onset(spark, d):
    """The first event at which a user's running value reaches half of its final one."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cents = F.round(F.col("value") * 100).cast("long")
    run = _t(spark, d, "events").withColumn("run", F.sum(cents).over(by_user)).withColumn("final", F.sum(cents).over(Window.partitionBy("user_id")))
    return run.where("2 * run >= final").groupBy("user_id").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


def tenth_percentile(spark, d):
    """Nearest-rank tenth percentile of order value by priority."""
    return ordered.nearest_rank(_t(spark, d, "orders"), "o_orderpriority", "o_totalprice", 0.1).select("o_orderpriority", F.col("rows").alias("n"), F.col("q").alias("p10"))


def trailing_events(spark, d):
    """Events of each type by hour, and over the 24 hours that end with it."""
    hours = _t(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp").alias("h")).agg(F.count("*").alias("n"))
    day = Window.partitionBy("event_type").orderBy(F.unix_seconds("h")).rangeBetween(-23 * 3600, 0)
    return hours.select("event_type", F.col("h").cast("timestamp_ntz").alias("hour"), "n", F.sum("n").over(day).alias("trailing"))


def constraint_audit(spark, d):
    """Violations by code: missing parents, repeated keys, values outside their list or range. Codes without any are listed."""
    orders, lines, docs = _t(spark, d, "orders"), _t(spark, d, "lineitem"), _t(spark, d, "documents")
    found = {
        "ORDER_PARENT": orders.join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "LINE_PARENT": lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "LINE_TWICE": lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "STATUS": orders.where("o_orderstatus is null or o_orderstatus not in ('F', 'O', 'P')"),
        "DISCOUNT": lines.where("l_discount is null or l_discount < 0 or l_discount > 0.05"),
        "LENGTH": docs.where("n_chars <> length(text)"),
    }
    counted = [rows.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n") for code, rows in found.items()]
    return reduce(DataFrame.unionByName, counted)


def minhash_groups(spark, d):
    """Near-duplicate groups of documents; the first by source number stays."""
    return minhash.near_duplicates(_t(spark, d, "documents"), [F.regexp_extract("source", "[0-9]+", 0).try_cast("int")])


def page_texts(spark, d):
    return _t(spark, d, "pages").select("page_id", html_text("html").alias("text"))


def json_lines(spark, d):
    """Documents and bytes by source after a trip through compressed JSON lines, with the lines that can't be read as a source of their own."""
    return jsonl.round_trip_report(spark, _t(spark, d, "documents").select("doc_id", "source", "text"))


def ranged_lines(spark, d):
    """The documents written as plain and packed line files, one of them torn, and read back by byte ranges and frames: documents, characters and keys by
    source and state. The torn line is the first document's, cut in its text."""
    scratch = Scratch(spark, "ranged")
    docs = _t(spark, d, "documents").select("doc_id", "source", "text")
    plain, packed, torn = (scratch.path(f"lines/{kind}") for kind in ("plain", "packed", "torn"))
    docs.where("doc_id % 2 = 0").write.json(plain)
    docs.where("doc_id % 2 <> 0").write.option("compression", "gzip").json(packed)
    first = docs.orderBy("doc_id").select(F.to_json(F.struct("doc_id", "source")).alias("line")).head()
    file = scratch._path(f"{torn}/part.jsonl")
    out = scratch._files(file).create(file)
    out.write(bytearray((first["line"][:-1] + ', "te').encode()) if first else bytearray())
    out.close()
    ranges.register(spark)
    back = spark.read.format("json_ranges").schema("doc_id long, source string, text string, _state string").option("rangeBytes", 100_000).load(scratch.path("lines"))
    counted = back.groupBy("source", F.col("_state").alias("state"))
    return counted.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum("doc_id"), F.lit(0)).alias("keys"))


def _arriving(spark, d, files=4):
    """The events as files that hold times of all days, each; a stream takes one of them a batch."""
    scratch = Scratch(spark, "arriving")
    scratch.keep(_t(spark, d, "events").repartition(files, F.xxhash64("event_id")), "events")
    return scratch.path("events")


def streamed_hours(spark, d):
    return stream.hourly(spark, _arriving(spark, d), "*.parquet", 1)


def streamed_first_documents(spark, d):
    return stream.first_documents(spark, d, "documents.parquet")


def streamed_windows(spark, d):
    return stream.sliding(spark, _arriving(spark, d), "*.parquet", 1)


def streamed_join(spark, d):
    return stream.joined(spark, _arriving(spark, d), "*.parquet", 1)


def streamed_attempts(spark, d):
    """Events as tries of users' jobs, in keyed state over several batches in any order of time."""
    back = jobs.with_store(spark)
    try:
        events = spark.readStream.schema(_t(spark, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(_arriving(spark, d))
        return jobs.attempts(events, Scratch(spark, "attempts").path("run")).select("user_id", "tries", "state")
    finally:
        back()


def ranked_commits(spark, d):
    """Lines of an order that arrive in any order, committed in that of their numbers: for each order how many lines and the sum of rank times part."""
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), "l_linenumber").agg(F.min("l_partkey").alias("item"))
    ranked = lines.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy("l_linenumber")).cast("long") - 1).select("grp", "rank", "item")
    scratch = Scratch(spark, "ranked")
    kept = scratch.keep(ranked.repartition(3, F.xxhash64("grp", "rank")), "lines")
    back = jobs.with_store(spark)
    try:
        done = jobs.in_rank(spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(scratch.path("lines")), scratch.path("run"))
        return done.groupBy("grp").agg(F.count("*").alias("lines"), F.sum((F.col("rank") + 1) * F.col("item")).alias("weighted"))
    finally:
        back()


_W = r"regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?')"
_PHRASES = "|".join(G.MODEL_PHRASES).replace("'", "''")
_ORDERS = "orders join customer on o_custkey = c_custkey"
ORACLES = {
    "late_text": f"""select source, count(*) as docs, count(*) filter (regexp_matches(replace(lower(text), '’', ''''), '{_PHRASES}')) as model_phrases,
        count(*) filter (regexp_matches(text, '{G.LATE_YEAR}')) as late_years from documents group by source""",
    "reserve_holdout": "select doc_id, right(sha256('reserve-1:' || doc_id), 1) in ('0', '8') as reserved from documents",
    "window_hashes": rf"""
        with b as (select item_id, {_W} as w from benchmark),
        g as (select item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as g from b where len(w) >= 13)
        select sha256(g) as sha256, count(distinct item_id) as items from g group by g""",
    "word_pairs": rf"""
        with w as (select {_W} as w from documents),
        p as (select unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as pair from w)
        select pair, count(*) as docs from p group by pair order by docs desc, pair limit 100""",
    "top_word_overlap": rf"""
        with w as (select lang, unnest({_W}) as word from documents), c as (select lang, word, count(*) as n from w group by all),
        t as (select lang, word from c qualify row_number() over (partition by lang order by n desc, word) <= 50),
        s as (select lang, count(*) as n from t group by lang),
        j as (select x.lang as a, y.lang as b, count(*) as shared from t x join t y using (word) where x.lang < y.lang group by all)
        select a, b, shared, round(shared / (p.n + q.n - shared), 9) as jaccard from j join s p on p.lang = a join s q on q.lang = b""",
    "subsample": "select doc_id, substr(sha256('sub-1:' || doc_id), 1, 8) as rank from documents order by rank, doc_id limit 100",
    "holm_step_down": f"""
        with p as (select c_nationkey, round(avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) / 20, 9) as p from {_ORDERS} group by 1),
        r as (select *, row_number() over (order by p, c_nationkey) as i, count(*) over () as m from p)
        select c_nationkey, p, bool_and(p <= 0.5 / (m - i + 1)) over (order by p, c_nationkey) as holds from r""",
    "paired_difference": f"""
        with d as (select c_nationkey, avg(o_totalprice) filter (o_orderpriority = '1-URGENT') - avg(o_totalprice) filter (o_orderpriority = '5-LOW') as diff
                   from {_ORDERS} group by 1)
        select count(diff) as pairs, round(avg(diff), 3) as mean, round(stddev_samp(diff), 3) as sd, round(avg(diff) / (stddev_samp(diff) / sqrt(count(diff))), 6) as t from d""",
    "pooled_deviation": f"""
        with r as (select c_nationkey, o_totalprice - avg(o_totalprice) over (partition by c_nationkey) as e, count(*) over (partition by c_nationkey) as n from {_ORDERS}),
        a as (select c_nationkey, sum(e * e) as s, count(*) - 1 as f from r where n > 1 group by 1)
        select cast(sum(f) as bigint) as freedom, round(sqrt(sum(s) / sum(f)), 3) as sd from a""",
    "onset": """
        with r as (select user_id, event_id, ts, sum(cast(round(value * 100) as bigint)) over (partition by user_id order by ts, event_id) as run,
                          sum(cast(round(value * 100) as bigint)) over (partition by user_id) as final from events)
        select user_id, event_id from r where 2 * run >= final qualify row_number() over (partition by user_id order by ts, event_id) = 1""",
    "tenth_percentile": "select o_orderpriority, count(*) as n, quantile_disc(o_totalprice, 0.1) as p10 from orders group by 1",
    "trailing_events": """
        with h as (select event_type, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2)
        select event_type, hour, n, cast(sum(n) over (partition by event_type order by hour range between interval 23 hours preceding and current row) as bigint) as trailing from h""",
    "constraint_audit": """
        select 'ORDER_PARENT' as code, count(*) as n from orders where not exists (select 1 from customer where c_custkey = o_custkey)
        union all select 'LINE_PARENT', count(*) from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey)
        union all select 'LINE_TWICE', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
        union all select 'STATUS', count(*) from orders where o_orderstatus is null or o_orderstatus not in ('F', 'O', 'P')
        union all select 'DISCOUNT', count(*) from lineitem where l_discount is null or l_discount < 0 or l_discount > 0.05
        union all select 'LENGTH', count(*) from documents where n_chars <> length(text)""",
    "json_lines": "select source, count(*) as docs, cast(sum(strlen(text)) as bigint) as bytes from documents group by source union all select 'bad_json', 1, 16",
    "ranged_lines": """
        select source, 'ok' as state, count(*) as docs, cast(coalesce(sum(length(text)), 0) as bigint) as chars, cast(sum(doc_id) as bigint) as keys from documents group by source
        union all select null, 'torn', 1, 0, 0 from (select 1 from documents limit 1)""",
    "ranked_commits": """
        with l as (select l_orderkey as grp, min(l_partkey) as item, row_number() over (partition by l_orderkey order by l_linenumber) as place from lineitem group by l_orderkey, l_linenumber)
        select grp, count(*) as lines, cast(sum(place * item) as bigint) as weighted from l group by 1""",
    "streamed_hours": "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 2) as value from events group by 1, 2",
    "streamed_windows": """
        with e as (select event_type, time_bucket(interval '2 hours', ts, timestamp '1970-01-01') as slot from events),
        w as (select event_type, slot - to_hours(2 * cast(i as integer)) as began from e, range(3) r(i))
        select began, event_type, count(*) as n from w group by 1, 2""",
    "streamed_join": """
        select p.event_id as purchase, c.event_id as click from events p join events c on p.user_id = c.user_id and p.event_type = 'purchase' and c.event_type = 'click'
            and c.ts <= p.ts and c.ts >= p.ts - interval 1 hour""",
    "streamed_attempts": """
        with a as (select user_id, event_type = 'purchase' as done, row_number() over (partition by user_id order by ts, event_id) as place from events where event_type in ('purchase', 'error')),
        u as (select user_id, count(*) as n, coalesce(min(place) filter (done), 1099511627776) as first from a group by 1)
        select user_id, least(n, first, 3) as tries, case when first <= 3 then 'accepted' when n >= 3 then 'given_up' else 'open' end as state from u""",
    "streamed_first_documents": """select doc_id, source from documents
        qualify row_number() over (partition by sha256(text) order by cast(regexp_extract(source, '[0-9]+') as int), doc_id) = 1""",
}
#: Groups by exact similarity of word shingles, as SQL can say it: all pairs that share a shingle, then reachability.
ORACLES["minhash_groups"] = r"""
    with recursive w as (select doc_id, cast(regexp_extract(source, '[0-9]+') as int) as rank, coalesce(text, '') as t,
                     regexp_extract_all(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[0-9]+', '0', 'g'), '[\p{L}\p{N}]+') as w from documents),
    s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then ['own ' || t] when len(w) < 5 then [array_to_string(w, ' ')]
                     else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as g from w),
    n as (select doc_id, count(*) as n from s group by doc_id),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
    l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where c * 1000 >= 800 * (x.n + y.n - c)),
    r(id, seen) as (select doc_id, doc_id from documents union select r.id, l.b from r join l on l.a = r.seen),
    g as (select r.id, arg_min(w.doc_id, (w.rank, w.doc_id)) as lead, count(*) as size from r join w on w.doc_id = r.seen group by r.id)
    select id as doc_id, lead, size, id = lead as kept from g"""
QUERIES = {name: globals()[name] for name in (*ORACLES, "page_texts")}
