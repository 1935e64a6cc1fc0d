"""Queries over gates on dates, licences and messages, and over clean-up. Fields that the tables lack are planted by document number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions import cleaning as C
from tamis.functions import dates as D
from tamis.functions import grams as G
from tamis.functions import licences as L
from tamis.functions import text as T
from tamis.operators import paths

#: Planted values: written dates, licences, wiki namespaces, stock comments and marked-up comments of all kinds that the rules tell apart.
DATES = (
    "2016-10-09T23:39:12Z", "09-30-2024", "04-9-2021", "08/27/2020", "Activity/Lab", "Mar 26, 2024", "Published on December 13, 2021", "1st December 2022",
    "Oct. 20, 2022", "26 July 2015 at 18:13", "08 Jul", "", None, "1862", "2022-11", "2022", "2022-11-30", "2022-12-01", "02-30-2020", "2021-02-29", "2021-13-01",
    " 2020-01-05 ", "3 of May 2019, then 4 June 2020", "June 4, 2020 or 3 May 2019", "0999",
)
LICENCES = (
    "Public Domain", "pd", "CC0", "cc-zero", "CC BY 4.0", "cc_by_sa", "cc by-sa v3.0", "CC-BY-NC", "Apache-2.0", "MIT", None, "None", "proprietary",
    "Creative Commons - Attribution - https://creativecommons.org/licenses/by/3.0/", "https://creativecommons.org/licenses/by-nc/4.0/",
    "https://creativecommons.org/publicdomain/mark/1.0/", "https://creativecommons.org/publicdomain/zero/1.0/", "Creative Commons Attribution", "",
)
SPACES = (("wikibooks.com", "0"), ("wikibooks.com", "1"), ("wikibooks.com", "102"), ("wikibooks.com", "110"), ("wikinews.com", "102"), ("wikinews.com", "4"), ("wikinews.com", None), (None, "103"))
COMMENTS = (
    "Possible duplicate of this one", "I'm voting to close this", "Please take the [tour](/tour) first", "See **bold** and *slanted* `code`", "A [link](https://x.org \"title\") here",
    "see the help center.", "plain words", "", None, "duplicates of", "From Review: fine", "<|user|>hi<|end|>", "a <think>b</think> c", "x\n| | |\ny\n|\n\nz", "||\nq\n |a|",
)
EDITS = (None, "", "2022-11-01T10:00:00", "2023-01-01T00:00:00", "not a date")


def planted(values: tuple, key: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def planted_sql(values: tuple, key: str = "doc_id") -> str:
    quoted = ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][cast({key} as bigint) % {len(values)} + 1]"


#: Forms in which a document's day is written, for Spark and for DuckDB.
FORMS = (
    ("yyyy-MM-dd", "%Y-%m-%d"), ("MM/dd/yyyy", "%m/%d/%Y"), ("MMMM d, yyyy", "%B %-d, %Y"), ("d MMMM yyyy", "%-d %B %Y"), ("MMM d, yyyy", "%b %-d, %Y"),
    ("yyyy-MM-dd'T10:00:00Z'", "%Y-%m-%dT10:00:00Z"),
)
_NUMBER = "(n_chars * 37 + doc_id * 11)"


def _number() -> Column:
    return F.col("n_chars") * 37 + F.col("doc_id") * 11


def _day() -> Column:
    """A document's day by its length and number, from 2004 to 2025: as many different ones as the table has documents, up to 8,000."""
    return F.date_add(F.lit("2004-01-01").cast("date"), F.pmod(_number(), F.lit(8000)).cast("int"))


_DAY_SQL = f"(date '2004-01-01' + cast({_NUMBER} % 8000 as integer))"


def written() -> Column:
    """A document's day in one of several forms; each seventh document has a planted odd one."""
    key = F.col("doc_id")
    form = F.coalesce(*(F.when(key % len(FORMS) == i, F.date_format(_day(), f)) for i, (f, _) in enumerate(FORMS)))
    return F.when(key % 7 == 0, planted(DATES, F.floor(key / 7))).otherwise(form)


def written_sql() -> str:
    forms = " ".join(f"when {i} then strftime({_DAY_SQL}, '{f}')" for i, (_, f) in enumerate(FORMS))
    return f"case when doc_id % 7 = 0 then {planted_sql(DATES, 'doc_id // 7')} else case doc_id % {len(FORMS)} {forms} end end"


def _docs(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def iso_dates(spark, d):
    """Each document's date status by the gate on ISO dates."""
    return _docs(spark, d).select("doc_id", D.iso_status(written()).alias("status"))


def _path() -> Column:
    """A planted address with a date in its path, or none."""
    return F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("https://www.news.example:80/"), (F.lit(2004) + _number() % 22).cast("string"), F.lit("/"), (_number() % 14).cast("string"), F.lit("/x/")))


def written_dates(spark, d):
    """Status, partial date and basis by the written date, else by the date in the address."""
    # an exploded array of one row keeps Spark from writing the values' expressions out wherever the gate reads them
    rows = _docs(spark, d).select("doc_id", F.explode(F.array(F.struct(written().alias("v"), _path().alias("u")))).alias("x"))
    found = D.classified(F.col("x.v"), F.col("x.u"), "news.example", month_first=True)
    return rows.select("doc_id", found.alias("c")).select("doc_id", "c.*")


def url_dates(spark, d):
    return _docs(spark, d).select("doc_id", D.host(_path()).alias("host"), D.in_url(_path()).alias("date"), F.when(F.col("doc_id") % 3 > 0, D.gate(F.coalesce(D.in_url(_path()), F.lit("2022")))).alias("gate"))


def licence_names(spark, d):
    """Documents by canonical licence: the one that a text says it is under, else a planted one; refused ones under null."""
    return _docs(spark, d).groupBy(L.canonical(F.coalesce(L.in_text(F.col("text")), planted(LICENCES, F.col("doc_id")))).alias("licence")).agg(F.count("*").alias("docs"))


def thread_licences(spark, d):
    """Why a thread's licences refuse it: a refused part counts before a missing one."""
    key = F.col("doc_id")
    parts = F.when(key % 5 > 0, F.array(planted(LICENCES, key), planted(LICENCES, F.floor(key / 7)))).otherwise(F.array().cast("array<string>"))
    return _docs(spark, d).select("doc_id", L.composite_reason(planted(LICENCES[:5], key), parts).alias("reason"))


def post_gates(spark, d):
    """Date and edit gate of posts, and the licence that holds: the post's own or its era's."""
    key = F.col("doc_id")
    odd = planted(DATES[:1] + DATES[11:18] + ("2010-01-01", "2011-04-08", "2018-05-01"), F.floor(key / 7))
    created, raw = F.when(key % 7 == 0, odd).otherwise(F.date_format(_day(), "yyyy-MM-dd")), planted(LICENCES, F.floor(key / 3))
    later = F.date_format(F.date_add(_day(), (F.col("n_chars") % 900).cast("int")), "yyyy-MM-dd'T10:00:00Z'")
    edited = F.when(key % 5 == 0, planted(EDITS, F.floor(key / 11))).otherwise(later)
    return _docs(spark, d).select("doc_id", D.post_gate(created, edited).alias("reason"), F.when(F.length(created) >= 10, L.of_post(raw, created)).alias("licence"))


def wiki_pages(spark, d):
    key = F.col("doc_id")
    reason = C.wiki_reason(planted(tuple(w for w, _ in SPACES), key), planted(tuple(n for _, n in SPACES), key))
    return _docs(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("pages"))


def comment_texts(spark, d):
    """Stock comments, control strings, and the text without marks, control strings and bar lines."""
    raw = planted(COMMENTS, F.col("doc_id"))
    return _docs(spark, d).select(
        "doc_id", C.comment_text(raw).alias("text"), F.coalesce(C.is_template(C.comment_text(raw)), F.lit(False)).alias("template"),
        C.control_strings(raw).alias("control"), C.without_control(raw).alias("plain"), C.without_bars(raw).alias("barless"),
    )


def normalized_texts(spark, d):
    """The hash of each text in its normal form, after odd line ends and blanks are planted."""
    dirty = F.concat(F.lit("\r\n \t"), F.replace("text", F.lit("\n"), F.lit(" \t\r\n")), F.lit("\r\r\n\n\n\nend \x00"))
    clean = _docs(spark, d).select("doc_id", C.normalized(dirty).alias("t"))
    return clean.select("doc_id", F.length("t").alias("chars"), F.sha1(F.col("t").cast("binary")).alias("sha1"))


def reader_report(spark, d):
    """Documents and bytes by source and the first gate that fails: licence, date, language, late text, hygiene."""
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    status = D.iso_status(planted(DATES, F.floor(key / 3)))
    late = G.model_phrase(text) | G.late_year(text)
    reason = (
        F.when(L.canonical(planted(LICENCES[:12], key)).isNull(), "license")
        .when(status == "post_cutoff", "date_gate")
        .when(status == "unparseable", "date_unparseable")
        .when(F.coalesce(F.col("lang") != "en", F.lit(True)), "lang_field")
        .when(late, "post_cutoff_marker")
        .otherwise(F.coalesce(T.hygiene_reason(text), F.lit("kept")))
    )
    return _docs(spark, d).select("source", reason.alias("reason"), F.octet_length(text).alias("b")).groupBy("source", "reason").agg(F.count("*").alias("docs"), F.sum("b").cast("long").alias("bytes"))


def unrecorded_licences(spark, d):
    """Sources whose documents have no licence on record and that aren't allowed for it: a sample that draws on them is refused."""
    none = F.coalesce(planted(LICENCES, F.col("doc_id")), F.lit("None")) == "None"
    open_ = _docs(spark, d).groupBy("source").agg(F.count("*").alias("docs"), F.count_if(none).alias("unrecorded"))
    return open_.where(~F.col("source").isin("src0", "src1")).select("*", (F.col("unrecorded") > 0).alias("blocked"))


def trainable(spark, d):
    """The reasons that block a record, in order."""
    key, licence = F.col("doc_id"), planted(("Apache-2.0", "FAKE", "MIT", "Apache-2.0"), F.col("doc_id"))
    fake = (key % 9 == 0) | (licence == "FAKE")
    blocked = F.array_compact(F.array(F.when(fake, "FAKE_PROVENANCE").when(licence != "Apache-2.0", "LICENSE"), F.when(key % 4 != 1, "DECON_PENDING")))
    return _docs(spark, d).select("doc_id", F.array_join(blocked, ",").alias("blocked"), (F.size(blocked) == 0).alias("trainable"))


def _messages(spark, d) -> DataFrame:
    """Documents as trees of 40 messages, each with two replies at most; ranks and faults are planted."""
    key, at = F.col("doc_id"), F.col("doc_id") % 40
    rows = _docs(spark, d).select(
        F.floor(key / 40).alias("tree"), key.alias("id"), F.when(at > 0, key - at + F.floor((at - 1) / 2)).alias("parent"), at.alias("place"),
        F.when(key % 3 > 0, (key * 7) % 5).alias("rank"), "lang", "text",
        C.message_problem(key % 17 == 5, key % 19 == 3, key % 23 != 7, F.when(key % 2 == 0, (key % 29) / 28.0), F.when(key % 13 == 1, "de").otherwise("en"), F.col("text"), G.model_phrase(F.col("text"))).alias("problem"),
    )
    return rows.withColumn("depth", F.floor(F.log2(F.col("place") + 1) + 1e-9).cast("int")).withColumn("role", F.when(F.col("depth") % 2 == 0, "user").otherwise("assistant"))


def message_problems(spark, d):
    """Messages of all trees by their first problem."""
    return _messages(spark, d).groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("messages"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


def best_paths(spark, d):
    """Of each tree the path of best usable replies, cut after its last assistant turn."""
    found = paths.best_path(_messages(spark, d).where("problem is null"), ["rank", "place"])
    ends = found.where("role = 'assistant'").groupBy("tree").agg(F.max("step").alias("last"))
    return found.join(ends, "tree").where("step <= last").select("tree", "step", "id", "role")


def deepest_paths(spark, d):
    """User turns on the usable path with the most of them that ends on an assistant turn, by tree."""
    every = paths.all_paths(_messages(spark, d).where("problem is null"))
    return every.where("role = 'assistant'").groupBy("tree").agg(F.max("users").alias("users"))


_DAY = f"regexp_extract(trim(v), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1)"
_ISO = f"""case when coalesce(trim(v), '') = '' then 'undated' when {_DAY} = '' or substr({_DAY}, 6, 2) not between '01' and '12'
    or substr({_DAY}, 9, 2) not between '01' and '31' then 'unparseable' when {_DAY} < '{D.CUTOFF}' then 'ok' else 'post_cutoff' end"""
_DOCS_WITH = "select *, {} as v from documents"
_PATH_SQL = f"case when doc_id % 3 > 0 then 'https://www.news.example:80/' || (2004 + {_NUMBER} % 22) || '/' || ({_NUMBER} % 14) || '/x/' end"


def _whole_sql(y: str, m: str, d: str) -> str:
    text = f"lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"
    return f"case when try_strptime({text}, '%Y-%m-%d') is not null and lpad({y}, 4, '0') between '1000' and '2100' then {text} end"


def _group(pattern: str, i: int, of: str = "s") -> str:
    return f"regexp_extract({of}, '{pattern}', {i})"


def _months_sql(y: str, m: str) -> str:
    return f"case when lpad({m}, 2, '0') between '01' and '12' and {y} between '1000' and '2100' then {y} || '-' || lpad({m}, 2, '0') end"


_NAMED = "cast((strpos('janfebmaraprmayjunjulaugsepoctnovdec', substr({}, 1, 3)) + 2) // 3 as varchar)"
_MONTH_AT, _DAY_AT = f"strpos(s, nullif({_group(D.MONTH_FIRST, 0)}, ''))", f"strpos(s, nullif({_group(D.DAY_FIRST, 0)}, ''))"
_PARSED = f"""case when {_group(D.FULL, 1)} <> '' then {_whole_sql(*(_group(D.FULL, i) for i in (1, 2, 3)))}
    when {_group(D.YEAR_MONTH, 1)} <> '' then {_months_sql(*(_group(D.YEAR_MONTH, i) for i in (1, 2)))}
    when {_group(D.YEAR, 1)} <> '' then case when s between '1000' and '2100' then s end
    when {_group(D.NUMBERS, 1)} <> '' then {_whole_sql(*(_group(D.NUMBERS, i) for i in (3, 1, 2)))}
    when {_MONTH_AT} is not null and ({_DAY_AT} is null or {_MONTH_AT} < {_DAY_AT})
        then {_whole_sql(_group(D.MONTH_FIRST, 3), _NAMED.format(_group(D.MONTH_FIRST, 1)), _group(D.MONTH_FIRST, 2))}
    when {_DAY_AT} is not null then {_whole_sql(_group(D.DAY_FIRST, 3), _NAMED.format(_group(D.DAY_FIRST, 2)), _group(D.DAY_FIRST, 1))} end"""
_IN_URL = f"""case when {_group(D.IN_PATH, 1, "u")} = '' then null when {_group(D.IN_PATH, 3, "u")} <> ''
    then {_whole_sql(*(_group(D.IN_PATH, i, "u") for i in (1, 2, 3)))} else {_months_sql(*(_group(D.IN_PATH, i, "u") for i in (1, 2)))} end"""
_GATE = "case when {0} || case length({0}) when 4 then '-12-31' when 7 then '-31' else '' end < '2022-12-01' then 'ok' else 'post_cutoff' end"


def _canonical(v: str) -> str:
    t = f"lower(trim({v}))"
    of = lambda i: f"regexp_extract({t}, '{L.ADDRESS}', {i})"
    short = lambda i: f"regexp_extract(replace({t}, '_', '-'), '{L.SHORT}', {i})"
    return f"""case when {t} in ('public domain', 'public-domain', 'pd') then 'public-domain' when {t} in ('apache-2.0', 'apache 2.0') then 'apache-2.0'
        when {t} = 'mit' then 'mit' when {of(1)} = 'publicdomain' then case {of(2)} when 'zero' then 'cc0' when 'mark' then 'public-domain' end
        when {of(1)} <> '' then case when {of(2)} in ('by', 'by-sa') then 'cc-' || {of(2)} || '-' || {of(3)} end
        when regexp_matches({t}, 'creativecommons|creative commons') then null when {short(1)} in ('zero', '0') then 'cc0'
        when {short(1)} <> '' then 'cc-' || replace({short(1)}, ' ', '-') || case when {short(2)} <> '' then '-' || {short(2)} else '' end end"""


_POSTED = f"""case when doc_id % 7 = 0 then {planted_sql(DATES[:1] + DATES[11:18] + ("2010-01-01", "2011-04-08", "2018-05-01"), "doc_id // 7")} else strftime({_DAY_SQL}, '%Y-%m-%d') end"""
_EDITED = f"""case when doc_id % 5 = 0 then {planted_sql(EDITS, "doc_id // 11")} else strftime({_DAY_SQL} + cast(n_chars % 900 as integer), '%Y-%m-%dT10:00:00Z') end"""
_OWN_LICENCE = f"nullif(regexp_replace(regexp_extract(coalesce(text, ''), '{L.SAID}', 1), '{L.TITLE_WORDS}', '', 'g'), '')"
_MARKS = "'" + "|".join(C.TEMPLATES).replace("'", "''") + "'"
_CONTROL = "'" + C.CONTROL_PATTERN + "'"
_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '\[([^\]\n]+)\]\((?:[^()\s]+)(?:\s+"[^"]*")?\)', '\1', 'g'),
    '\*\*([^*\n]+)\*\*', '\1', 'g'), '\*([^*\n]+)\*', '\1', 'g'), '`([^`\n]+)`', '\1', 'g'), '\s+', ' ', 'g'))"""
_PHRASES = "|".join(G.MODEL_PHRASES).replace("'", "''")
_LATE = f"regexp_matches(replace(lower(coalesce(text, '')), '’', ''''), '{_PHRASES}') or regexp_matches(coalesce(text, ''), '{G.LATE_YEAR}')"
_STOP = "'" + "', '".join(w.replace("'", "''") for w in T.STOPWORDS.split()) + "'"
_W = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+(?:''\p{L}+)?')"
_LETTERS, _PLAIN = r"len(regexp_extract_all(coalesce(text, ''), '\p{L}'))", "len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]'))"
_HYGIENE = f"""case when coalesce(text, '') = '' then 'empty' when strlen(text) < 200 then 'too_short'
    when {_LETTERS} > 0 and ({_LETTERS} - {_PLAIN}) / {_LETTERS} > 0.30 then 'non_ascii'
    when len({_W}) = 0 or len(list_filter({_W}, lambda w: w in ({_STOP}))) / len({_W}) < 0.10 then 'not_english' else 'kept' end"""
_MESSAGES = f"""select doc_id // 40 as tree, doc_id as id, doc_id % 40 as place, case when doc_id % 40 > 0 then doc_id - doc_id % 40 + (doc_id % 40 - 1) // 2 end as parent,
    case when doc_id % 3 > 0 then (doc_id * 7) % 5 end as rank, case when floor(log2(doc_id % 40 + 1) + 1e-9) % 2 = 0 then 'user' else 'assistant' end as role, text,
    case when doc_id % 17 = 5 then 'deleted' when doc_id % 19 = 3 then 'synthetic' when doc_id % 23 = 7 then 'review_failed'
        when doc_id % 2 = 0 and (doc_id % 29) / 28.0 >= 0.5 then 'spam' when doc_id % 13 = 1 then 'lang_mismatch' when coalesce(trim(text), '') = '' then 'empty'
        when regexp_matches(replace(lower(text), '’', ''''), '{_PHRASES}') then 'aiism' end as problem from documents"""
ORACLES = {
    "iso_dates": f"select doc_id, {_ISO} as status from ({_DOCS_WITH.format(written_sql())})",
    "written_dates": f"""
        with c as (select doc_id, v, lower(trim(v)) as s, u, not regexp_matches(coalesce(v, ''), '[0-9]') as missing
                   from (select doc_id, {written_sql()} as v, {_PATH_SQL} as u from documents)),
        p as (select doc_id, missing, case when not missing then {_PARSED} end as own, {_IN_URL} as path from c), a as (select *, coalesce(own, path) as date from p)
        select doc_id, case when date is not null then {_GATE.format("date")} when missing then 'undated' else 'unparseable' end as status, date,
               case when own is not null then 'field' when path is not null then 'url' end as basis from a""",
    "url_dates": f"""
        with c as (select doc_id, {_PATH_SQL} as u from documents), p as (select doc_id, u, {_IN_URL} as date from c)
        select doc_id, case when u is null then '' else 'news.example' end as host, date, case when u is not null then {_GATE.format("coalesce(date, '2022')")} end as gate from p""",
    "licence_names": f"select {_canonical('v')} as licence, count(*) as docs from ({_DOCS_WITH.format(f'coalesce({_OWN_LICENCE}, {planted_sql(LICENCES)})')}) group by 1",
    "thread_licences": f"""
        with c as (select doc_id, {planted_sql(LICENCES[:5])} as w, case when doc_id % 5 > 0 then [{planted_sql(LICENCES)}, {planted_sql(LICENCES, "doc_id // 7")}] else [] end as parts from documents),
        e as (select doc_id, unnest(parts) as v from c),
        b as (select doc_id, bool_or(v is not null and v <> 'None' and ({_canonical("v")}) is null) as bad, bool_or(v is null or v = 'None') as blank from e group by 1)
        select doc_id, case when ({_canonical("w")}) is null or bad then 'license' when blank then 'license_component_missing' end as reason from c left join b using (doc_id)""",
    "post_gates": f"""
        with c as (select doc_id, {_POSTED} as created, {_EDITED} as edited, {planted_sql(LICENCES, "doc_id // 3")} as raw from documents),
        s as (select *, (select {_ISO} from (select created as v)) as own, (select {_ISO} from (select edited as v)) as edit from c)
        select doc_id, case when own = 'post_cutoff' then 'date_gate' when own <> 'ok' then 'date_missing' when edit not in ('ok', 'undated') then 'edit_gate' end as reason,
               case when length(created) >= 10 then case when coalesce(raw, '') <> '' then {_canonical("raw")}
                   when created[1:10] < '2011-04-08' then 'cc-by-sa-2.5' when created[1:10] < '2018-05-02' then 'cc-by-sa-3.0' else 'cc-by-sa-4.0' end end as licence from s""",
    "wiki_pages": f"""
        with c as (select {planted_sql(tuple(w for w, _ in SPACES))} as w, {planted_sql(tuple(n for _, n in SPACES))} as n from documents)
        select case when coalesce(n = '0' or (w = 'wikibooks.com' and n in ('102', '110')), false) then null
                    when coalesce(regexp_full_match(n, '[0-9]*[13579]'), false) then 'wiki_talk' else 'wiki_namespace' end as reason, count(*) as pages from c group by 1""",
    "comment_texts": rf"""
        select doc_id, {_TEXT} as text, coalesce(regexp_matches(lower({_TEXT}), {_MARKS}), false) as template, cast(len(coalesce(regexp_extract_all(v, {_CONTROL}), [])) as integer) as control,
               regexp_replace(v, {_CONTROL}, ' ', 'g') as plain,
               array_to_string(list_filter(string_split(v, chr(10)), lambda l: not regexp_full_match(l, '[\s|]*\|[\s|]*')), chr(10)) as barless from ({_DOCS_WITH.format(planted_sql(COMMENTS))})""",
    "normalized_texts": r"""
        with c as (select doc_id, nfc_normalize(replace(text, chr(13), '')) as t from documents),
        n as (select doc_id, regexp_replace(regexp_replace(t, '[\t \x{A0}]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as t from c),
        e as (select doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') as t from n), f as (select doc_id, case when t = '' then 'end' else t || chr(10) || chr(10) || 'end' end as t from e)
        select doc_id, cast(length(t) as integer) as chars, sha1(t) as sha1 from f""",
    "reader_report": f"""
        with c as (select *, {planted_sql(DATES, "doc_id // 3")} as v, {planted_sql(LICENCES[:12])} as lic from documents),
        r as (select source, strlen(coalesce(text, '')) as b, case when ({_canonical("lic")}) is null then 'license' when ({_ISO}) = 'post_cutoff' then 'date_gate'
                when ({_ISO}) = 'unparseable' then 'date_unparseable' when coalesce(lang <> 'en', true) then 'lang_field' when {_LATE} then 'post_cutoff_marker' else {_HYGIENE} end as reason from c)
        select source, reason, count(*) as docs, cast(sum(b) as bigint) as bytes from r group by all""",
    "unrecorded_licences": f"""
        select source, count(*) as docs, count(*) filter (coalesce(v, 'None') = 'None') as unrecorded, count(*) filter (coalesce(v, 'None') = 'None') > 0 as blocked
        from ({_DOCS_WITH.format(planted_sql(LICENCES))}) where source not in ('src0', 'src1') group by source""",
    "trainable": f"""
        with c as ({_DOCS_WITH.format(planted_sql(("Apache-2.0", "FAKE", "MIT", "Apache-2.0")))}),
        b as (select doc_id, concat_ws(',', case when doc_id % 9 = 0 or v = 'FAKE' then 'FAKE_PROVENANCE' when v <> 'Apache-2.0' then 'LICENSE' end,
                                            case when doc_id % 4 <> 1 then 'DECON_PENDING' end) as blocked from c)
        select doc_id, blocked, blocked = '' as trainable from b""",
    "message_problems": f"select coalesce(problem, 'ok') as problem, count(*) as messages, cast(sum(strlen(text)) as bigint) as bytes from ({_MESSAGES}) group by 1",
    "best_paths": f"""
        with recursive m as ({_MESSAGES}), u as (select * from m where problem is null),
        best as (select parent, arg_min(id, (rank is null, coalesce(rank, 0), place)) as id from u where parent is not null group by parent),
        walk as (select tree, 0 as step, id, role from u where parent is null
                 union all select w.tree, w.step + 1, b.id, u.role from walk w join best b on b.parent = w.id join u on u.id = b.id),
        e as (select tree, max(step) as last from walk where role = 'assistant' group by tree)
        select tree, step, id, role from walk join e using (tree) where step <= last""",
    "deepest_paths": f"""
        with recursive m as ({_MESSAGES}), u as (select * from m where problem is null),
        walk as (select tree, id, role, 1 as users from u where parent is null
                 union all select u.tree, u.id, u.role, w.users + case when u.role = 'user' then 1 else 0 end from walk w join u on u.parent = w.id)
        select tree, max(users) as users from walk where role = 'assistant' group by tree""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
