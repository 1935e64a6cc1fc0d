"""Joins and deduplication across tiers, splits and threads, and plans of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import grams as G
from tamis.functions import text as T
from tamis.functions.cleaning import normalized
from tamis.operators import dedup, planning, sampling

#: Shares of bytes by language that a sample should have.
SHARES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def _docs(spark, d, *columns) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select(*columns) if columns else rows


def _sha(text: str = "text"):
    return F.sha1(F.col(text).cast("binary"))


def _number():
    return F.regexp_extract("source", "[0-9]+", 0).try_cast("int")


def _group():
    """A planted address: every fourth document is a version of one of eight pages, the others have none and are groups of their own."""
    return F.when(F.col("doc_id") % 4 == 0, T.url_key(F.concat(F.lit("https://www.Site.example/p"), (F.col("doc_id") % 32).cast("string"), F.lit("/#v"), F.col("doc_id").cast("string")))).otherwise(_sha())


def exact_dedup_reasons(spark, d):
    """Documents by what one scan in order of source and id says of them."""
    rows = _docs(spark, d, _number().alias("tier"), "doc_id", _sha().alias("sha1"), F.col("doc_id").cast("string").alias("id"))
    return dedup.greedy_reasons(rows, ["tier", "doc_id"], "sha1", "id").select("doc_id", "reason")


def boilerplate_groups(spark, d):
    """Lines in at least three groups, where all versions of a page are one."""
    return dedup.frequent_group_lines(_docs(spark, d, "doc_id", "text"), _group(), 3)


def first_version_lines(spark, d):
    """Lines in at least three documents, counting a text and an address only where they first occur."""
    rows = _docs(spark, d, "doc_id", "text", _sha().alias("sha1"), _group().alias("page"))
    first = lambda key: F.min("doc_id").over(Window.partitionBy(key))
    led = rows.groupBy("sha1").agg(F.min("doc_id").alias("a")).join(rows.groupBy("page").agg(F.min("doc_id").alias("b")), F.col("a") == F.col("b")).select(F.col("a").alias("doc_id"))
    return dedup.frequent_lines(rows.join(led, "doc_id", "left_semi"), 3)


def boilerplate_texts(spark, d):
    """Bytes and hash of each text without its common lines, in normal form."""
    docs = _docs(spark, d, "doc_id", "text")
    left = dedup.without_lines(docs, dedup.frequent_group_lines(docs, _group(), 3)).select("doc_id", normalized(F.col("text")).alias("text"))
    return left.select("doc_id", F.octet_length("text").alias("bytes"), _sha().alias("sha1"))


def later_tier(spark, d):
    """Documents of later sources whose text no earlier tier has, each text once."""
    rows = _docs(spark, d, "doc_id", "source", _sha().alias("sha1"))
    early = rows.where(F.col("source").isin("src0", "src1", "src2")).select("sha1").distinct()
    late = rows.where(~F.col("source").isin("src0", "src1", "src2")).join(early, "sha1", "left_anti")
    return late.groupBy("sha1").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def name_owners(spark, d):
    """Of customers with one name the one with the highest balance keeps it, of equal ones the first."""
    name = F.lower(F.concat("c_mktsegment", F.lit("-"), (F.col("c_custkey") % 97).cast("string")))
    best = F.max(F.struct(F.col("c_acctbal"), (-F.col("c_custkey")).alias("k")))
    return spark.read.parquet(f"{d}/customer.parquet").groupBy(name.alias("name")).agg((-best["k"]).alias("c_custkey"), F.count("*").alias("claims"))


def mirror_diff(spark, d):
    """Rows by how a planted mirror differs: equal, changed, or on one side only."""
    own = _docs(spark, d, "doc_id", _sha().alias("a"))
    other = _docs(spark, d).where("doc_id % 50 <> 3").select(F.when(F.col("doc_id") % 30 == 2, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 20 == 1, F.sha1(F.concat("text", F.lit("x")).cast("binary"))).otherwise(_sha()).alias("b"))
    both = own.join(other, "doc_id", "full")
    state = F.when(F.col("b").isNull(), "own_only").when(F.col("a").isNull(), "mirror_only").when(F.col("a") == F.col("b"), "equal").otherwise("changed")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("rows"))


def sidecar_coverage(spark, d):
    """Documents by source: all, with a label, and labels that contradict the side table's own count."""
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.lit(1).alias("has"), "quality")
    rows = _docs(spark, d, "doc_id", "source").join(labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("expected"), F.count("has").alias("done"), F.count_if(F.col("has").isNull()).alias("missing"), F.count_if(F.col("quality") == 0).alias("failed"))


def text_owners(spark, d):
    """Each document's owner: the best-ranked document of its text, over base rows and overrides."""
    rows = _docs(spark, d, "doc_id", _sha().alias("sha1"), F.when(F.col("doc_id") % 9 == 4, 0).otherwise(_number() + 1).alias("rank"))
    owner = rows.groupBy("sha1").agg(F.min(F.struct("rank", "doc_id"))["doc_id"].alias("owner"))
    return rows.join(owner, "sha1").select("doc_id", "owner")


def dropped_relations(spark, d):
    """Dropped documents by how they relate to the one that stays: same source or another, same language or another."""
    rows = _docs(spark, d, "doc_id", "source", "lang", _sha().alias("sha1"))
    lead = rows.groupBy("sha1").agg(F.min(F.struct("doc_id", "source", "lang")).alias("l"))
    lost = rows.join(lead, "sha1").where("doc_id <> l.doc_id")
    relation = F.when(F.col("source") == F.col("l.source"), "same_source").when(F.col("lang") == F.col("l.lang"), "other_source").otherwise("other_language")
    return lost.groupBy(relation.alias("relation")).agg(F.count("*").alias("docs"))


def _posts(spark, d) -> DataFrame:
    key = F.col("doc_id")
    return _docs(spark, d).select(key.alias("id"), (key - key % 6).alias("thread"), (key % 6 == 0).alias("question"), (key * 31 % 11).alias("score"), (key % 6 == 1 + F.floor(key / 6) % 5).alias("accepted"), F.octet_length("text").alias("bytes")).where("not (question and id % 7 = 0)")


def threads(spark, d):
    """Questions with their answers: the accepted one, then by score, then by id. Answers without their question are left out."""
    posts = _posts(spark, d)
    order = F.array_sort(F.collect_list(F.struct((~F.col("accepted")).alias("o"), (-F.col("score")).alias("s"), F.col("id").alias("i"))))
    answers = posts.where("not question").groupBy("thread").agg(F.array_join(F.transform(order, lambda x: x["i"].cast("string")), ",").alias("answers"), F.sum("bytes").cast("long").alias("more"))
    whole = posts.where("question").join(answers, "thread", "left")
    return whole.select("thread", F.coalesce("answers", F.lit("")).alias("answers"), (F.col("bytes") + F.coalesce("more", F.lit(0))).cast("long").alias("bytes"))


def orphan_answers(spark, d):
    """Answers whose question isn't there, by thread."""
    posts = _posts(spark, d)
    return posts.where("not question").join(posts.where("question").select("thread"), "thread", "left_anti").groupBy("thread").agg(F.count("*").alias("answers"))


def split_overlap(spark, d):
    """What train and evaluation rows share, by kind of key; an honest split has zeros for ids and split keys."""
    rows = sampling.hash_split(_docs(spark, d, "doc_id", "source", _sha().alias("sha1")), F.col("doc_id").cast("string"), "split-3", 0.2)
    keys = F.array(F.struct(F.lit("id").alias("kind"), F.col("doc_id").cast("string").alias("k")), F.struct(F.lit("split_key").alias("kind"), F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("k")), F.struct(F.lit("text").alias("kind"), F.col("sha1").alias("k")))
    each = rows.select("held_out", F.explode(keys).alias("e")).select("held_out", "e.kind", "e.k")
    sides = each.groupBy("kind", "k").agg(F.max("held_out").alias("some_out"), F.min("held_out").alias("all_out"))
    return sides.groupBy("kind").agg(F.count_if(F.col("some_out") & ~F.col("all_out")).alias("shared"), F.count("*").alias("keys"))


def heldout_exclusion(spark, d):
    """Documents none of whose keys (id, split key, text) is a held-out one's."""
    rows = sampling.hash_split(_docs(spark, d, "doc_id", "source", _sha().alias("sha1")), F.col("doc_id").cast("string"), "split-3", 0.2)
    keys = F.array(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("s"), F.col("source"), F.lit(":"), F.floor(F.col("doc_id") / 3).cast("string")), F.concat(F.lit("t"), F.col("sha1")))
    each = rows.select("doc_id", "held_out", F.explode(keys).alias("k"))
    hit = each.where("not held_out").join(each.where("held_out").select("k").distinct(), "k", "left_semi").select("doc_id").distinct()
    return rows.where("not held_out").join(hit, "doc_id", "left_anti").select("doc_id")


def leaked_conversations(spark, d):
    """Reserved conversations one of whose user turns of 40 characters or more stands, small and with single blanks, in another one."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'user'")
    said = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    rows = turns.select("conv_id", said.alias("said"), G.in_reserve("reserve-2:", F.col("conv_id")).alias("reserved")).where("length(said) >= 40")
    outside = rows.where("not reserved").select("said").distinct()
    return rows.where("reserved").join(outside, "said", "left_semi").select("conv_id").distinct()


def first_echo(spark, d):
    """The first run of five words, in text order, that a document shares with the benchmark."""
    def runs(rows, key):
        worded = rows.select(key, T.words(F.col("text")).alias("w"))
        return worded.select(key, F.posexplode_outer(G.grams(F.col("w"), 5)).alias("at", "g")).where("g is not null")

    bench = runs(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id").select("g").distinct()
    hits = runs(_docs(spark, d, "doc_id", "text"), "doc_id").join(bench, "g", "left_semi")
    return hits.groupBy("doc_id").agg(F.min(F.struct("at", "g")).alias("f"), F.count("*").alias("hits")).select("doc_id", "f.at", "f.g", "hits")


def contained_sentences(spark, d):
    """Documents by the benchmark sentences of 30 characters or more that they hold as they are. Two words block the pairs, the text decides."""
    parts = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.explode_outer(F.split("text", r"[.\n]")).alias("s"))
    sentences = parts.select("item_id", F.trim("s").alias("s")).where("length(s) >= 30").distinct()
    worded = sentences.select("item_id", "s", T.words(F.col("s")).alias("w"))
    keyed = worded.select("item_id", "s", F.try_element_at(G.grams(F.col("w"), 4), F.lit(1)).alias("g")).where("g is not null")
    docs = _docs(spark, d, "doc_id", "text").select("doc_id", "text", T.words(F.col("text")).alias("w"))
    probes = docs.select("doc_id", F.explode_outer(F.array_distinct(G.grams(F.col("w"), 4))).alias("g")).where("g is not null")
    met = probes.join(keyed, "g").select("doc_id", "item_id", "s").distinct()
    held = met.join(_docs(spark, d, "doc_id", "text"), "doc_id").where(F.contains("text", F.col("s")))
    return held.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("s").alias("sentences"))


def hash_prefix_split(spark, d):
    """Held-out documents: of each source the lowest 64-bit units, as far as comes closest to a quarter of its bytes or 5 MB."""
    rows = _docs(spark, d, "doc_id", "source", F.octet_length("text").cast("long").alias("bytes"))
    rows = rows.withColumn("u", F.round(sampling.unit_hash("7", F.col("source"), F.floor(F.col("doc_id") / 2)), 15))
    split = sampling.held_out_prefix(rows, "source", "u", "bytes", F.least(F.lit(5e6), F.col("whole") * 0.25), "doc_id")
    return split.select("doc_id", "held_out")


def sample_plan(spark, d):
    """Bytes to take by language so that the shares hold; short supply shrinks the whole."""
    shares = spark.createDataFrame(list(SHARES.items()), "name string, share double")
    have = _docs(spark, d).groupBy(F.col("lang").alias("name")).agg(F.sum(F.octet_length("text")).alias("supply"))
    plan = planning.group_targets(shares.join(have, "name", "left"), 1e12)
    return plan.select(F.col("name").alias("lang"), F.round("target", 3).alias("target"))


def modular_sample(spark, d):
    """Documents in two samples of a twentieth each, by a hash modulo 20."""
    last = F.conv(F.substring(F.sha1(F.concat(F.lit("ab|"), F.col("doc_id").cast("string")).cast("binary")), 33, 8), 16, 10).cast("long") % 20
    part = F.when(last == 0, "A").when(last == 1, "B")
    return _docs(spark, d).select("doc_id", part.alias("sample")).where("sample is not null")


_URL = "case when doc_id % 4 = 0 then 'site.example/p' || (doc_id % 32) else sha1(text) end"
_UNIT = "cast(concat('0x', substr(sha256(concat_ws('|', 'split-3', doc_id)), 1, 8)) as ubigint)::double / 4294967296.0 < 0.2"
_LINES = "select doc_id, grp, trim(l) as line from (select doc_id, {} as grp, unnest(string_split(text, chr(10))) as l from documents) where trim(l) <> ''"
_POSTS = """select doc_id as id, doc_id - doc_id % 6 as thread, doc_id % 6 = 0 as question, doc_id * 31 % 11 as score, doc_id % 6 = 1 + (doc_id // 6) % 5 as accepted, strlen(text) as bytes
    from documents where not (doc_id % 6 = 0 and doc_id % 7 = 0)"""
_W = r"regexp_extract_all(lower(text), '\p{L}+(?:''\p{L}+)?')"
_RUN = "list_transform(range(1, len(w) - {}), lambda i: array_to_string(w[i:i + {}], ' '))"
ORACLES = {
    "exact_dedup_reasons": """
        select doc_id, case when row_number() over (partition by sha1(text) order by cast(regexp_extract(source, '[0-9]+') as int), doc_id) = 1 then 'kept' else 'dup_exact' end as reason from documents""",
    "boilerplate_groups": f"select sha256(line) as line_hash, count(distinct grp) as groups from ({_LINES.format(_URL)}) group by 1 having count(distinct grp) >= 3",
    "first_version_lines": f"""
        with r as (select doc_id, text, min(doc_id) over (partition by sha1(text)) as a, min(doc_id) over (partition by {_URL}) as b from documents),
        l as (select doc_id, trim(unnest(string_split(text, chr(10)))) as line from r where doc_id = a and doc_id = b)
        select sha256(line) as line_hash, count(distinct doc_id) as docs from l where line <> '' group by 1 having count(distinct doc_id) >= 3""",
    "boilerplate_texts": rf"""
        with bad as (select line from ({_LINES.format(_URL)}) group by line having count(distinct grp) >= 3),
        l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as place from documents),
        k as (select doc_id, string_agg(line, chr(10) order by place) as t from l where trim(line) not in (select line from bad) group by doc_id),
        n as (select doc_id, case when text is null then null else coalesce(t, '') end as t from documents left join k using (doc_id)),
        c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(nfc_normalize(replace(t, chr(13), '')), '[\t \x{{A0}}]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as t from n)
        select doc_id, cast(strlen(t) as integer) as bytes, sha1(t) as sha1 from c""",
    "later_tier": """
        with r as (select doc_id, source in ('src0', 'src1', 'src2') as early, sha1(text) as h from documents)
        select min(doc_id) as doc_id from r where not early and h not in (select h from r where early) group by h""",
    "name_owners": """
        with n as (select *, lower(c_mktsegment || '-' || (c_custkey % 97)) as name from customer)
        select name, c_custkey, claims from (select *, count(*) over (partition by name) as claims from n) qualify row_number() over (partition by name order by c_acctbal desc, c_custkey) = 1""",
    "mirror_diff": """
        with o as (select case when doc_id % 30 = 2 then -doc_id else doc_id end as id, case when doc_id % 20 = 1 then sha1(text || 'x') else sha1(text) end as b from documents where doc_id % 50 <> 3)
        select case when b is null then 'own_only' when doc_id is null then 'mirror_only' when sha1(text) = b then 'equal' else 'changed' end as state, count(*) as rows
        from documents full join o on id = doc_id group by 1""",
    "sidecar_coverage": """
        select source, count(*) as expected, count(l.doc_id) as done, count(*) filter (l.doc_id is null) as missing, count(*) filter (quality = 0) as failed
        from documents left join labels l using (doc_id) group by source""",
    "text_owners": """
        with r as (select doc_id, sha1(text) as h, case when doc_id % 9 = 4 then 0 else cast(regexp_extract(source, '[0-9]+') as int) + 1 end as rank from documents)
        select doc_id, first_value(doc_id) over (partition by h order by rank, doc_id) as owner from r""",
    "dropped_relations": """
        with r as (select *, first_value(doc_id) over w as lead, first_value(source) over w as ls, first_value(lang) over w as ll from documents window w as (partition by sha1(text) order by doc_id))
        select case when source = ls then 'same_source' when lang = ll then 'other_source' else 'other_language' end as relation, count(*) as docs from r where doc_id <> lead group by 1""",
    "threads": f"""
        with p as ({_POSTS}), a as (select thread, string_agg(cast(id as varchar), ',' order by not accepted, -score, id) as answers, sum(bytes) as more from p where not question group by thread)
        select p.thread, coalesce(answers, '') as answers, cast(bytes + coalesce(more, 0) as bigint) as bytes from p left join a using (thread) where question""",
    "orphan_answers": f"with p as ({_POSTS}) select thread, count(*) as answers from p where not question and thread not in (select thread from p where question) group by thread",
    "split_overlap": f"""
        with r as (select {_UNIT} as o, doc_id, source, sha1(text) as h from documents),
        e as (select o, 'id' as kind, cast(doc_id as varchar) as k from r union all select o, 'split_key', source || ':' || doc_id from r union all select o, 'text', h from r),
        s as (select kind, k, bool_or(o) and not bool_and(o) as mixed from e group by kind, k)
        select kind, count(*) filter (mixed) as shared, count(*) as keys from s group by kind""",
    "heldout_exclusion": f"""
        with r as (select {_UNIT} as o, doc_id, ['i' || doc_id, 's' || source || ':' || (doc_id // 3), 't' || sha1(text)] as ks from documents), e as (select o, doc_id, unnest(ks) as k from r),
        hit as (select doc_id from e where not o and k in (select k from e where o))
        select doc_id from r where not o and doc_id not in (select doc_id from hit)""",
    "leaked_conversations": r"""
        with r as (select conv_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as said, right(sha256('reserve-2:' || conv_id), 1) in ('0', '8') as reserved from conversations where role = 'user')
        select distinct conv_id from r where reserved and length(said) >= 40 and said in (select said from r where not reserved)""",
    "first_echo": f"""
        with b as (select distinct unnest({_RUN.format(3, 4)}) as g from (select {_W} as w from benchmark) where len(w) >= 5),
        d as (select doc_id, unnest({_RUN.format(3, 4)}) as g, unnest(range(len(w) - 4)) as place from (select doc_id, {_W} as w from documents) where len(w) >= 5),
        h as (select * from d where g in (select g from b))
        select doc_id, cast(min(place) as integer) as "at", arg_min(g, place) as g, count(*) as hits from h group by doc_id""",
    "contained_sentences": rf"""
        with s as (select distinct item_id, trim(unnest(regexp_split_to_array(text, '[.\n]'))) as s from benchmark),
        k as (select item_id, s from (select item_id, s, {_W.replace("text", "s")} as w from s) where length(s) >= 30 and len(w) >= 4)
        select item_id, count(distinct doc_id) as docs, count(distinct s) as sentences from k join documents on contains(text, s) group by item_id""",
    "hash_prefix_split": """
        with h as (select *, strlen(text) as bytes, sha256('7' || chr(31) || source || chr(31) || (doc_id // 2)) as x from documents),
        u as (select doc_id, source, bytes, round((cast('0x' || substr(x, 1, 8) as ubigint)::double * 4294967296.0 + cast('0x' || substr(x, 9, 8) as ubigint)::double) / pow(2.0, 64), 15) as u from h),
        c as (select *, sum(bytes) over (partition by source order by u, doc_id rows unbounded preceding) as run, least(5e6, 0.25 * sum(bytes) over (partition by source)) as target,
                     row_number() over (partition by source order by u, doc_id) as place from u),
        b as (select source, arg_min(u, (abs(run - target), place)) as last, min(abs(run - target)) as gap, max(target) as target from c group by source)
        select doc_id, gap < b.target and u <= last as held_out from c join b using (source)""",
    "sample_plan": f"""
        with w(lang, share) as (values {", ".join(f"('{g}', {s})" for g, s in SHARES.items())}),
        h as (select w.lang, share, coalesce(sum(strlen(text)), 0) as b from w left join documents using (lang) group by all)
        select lang, round(share * 1e12 * least(1.0, (select min(b / (share * 1e12)) from h)), 3) as target from h""",
    "modular_sample": """
        with m as (select doc_id, cast('0x' || substr(sha1('ab|' || doc_id), 33, 8) as ubigint) % 20 as m from documents)
        select doc_id, case m when 0 then 'A' else 'B' end as sample from m where m < 2""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
