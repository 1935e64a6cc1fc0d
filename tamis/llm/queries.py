"""The registered queries of this subpackage and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import byte_bpe, collocations, decontaminate, fim, knn, page_density, pii, quality, secrets, sharding, simhash, token_rollup, toxicity
from tamis.session import Scratch

SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from pairs of labelled ones outside the held-out third; a null key is not held out."""
    held_out = quality.held_out(F.col("doc_id"), 3, 1)
    scored = quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards by its key alone, and in the one that it would have with one shard more."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by voters whose reliabilities come from all texts, and labels outside the held-out quarter."""
    held_out = quality.held_out(F.col("doc_id"), 4, 2)
    scored = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: those of the three base kinds, and the spans of all rules."""
    return secrets.digest(table(spark, sf_dir, "documents"))


def op5_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the least key that it is linked to, step by step, by fingerprints two bits apart."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads every document at a byte estimate, revises the counts by two tokenizer versions, withdraws texts of fewer than 5 words,
    puts them back, and compacts the batches halfway: totals of every document. Counts by real tokenizers fit the same way."""
    scratch = Scratch(spark, "token-rollup")
    versions = {v: token_rollup.count_matches(F.col("text"), p) for v, p in token_rollup.VERSIONS.items()}
    counts = scratch.keep(token_rollup.measured(table(spark, sf_dir, "documents"), versions), "counts")
    exact = {v: {"tokens": f"n_{i}", "was": "estimate"} for i, v in enumerate(versions)}
    loaded = token_rollup.by_version(counts, {v: {"tokens": "estimate"} for v in versions})
    rollup = token_rollup.TokenRollup(spark, scratch.path("totals"))
    rollup.commit(1, token_rollup.inserted(loaded))
    rollup.commit(2, token_rollup.revised(token_rollup.by_version(counts, exact)))
    rollup.commit(3, token_rollup.deleted(token_rollup.by_version(counts.where("n_0 < 5"), exact)))
    rollup.compact()
    rollup.commit(2, token_rollup.revised(token_rollup.by_version(counts, exact)))  # a replay, which changes nothing
    rollup.commit(4, token_rollup.inserted(token_rollup.by_version(counts.where("n_0 < 5"), exact)))
    return rollup.totals()


def op7_window_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of the benchmark, and the items whose windows it holds."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")


def op8_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector with all others."""
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: those of the four base kinds, and what the labelers together accept besides."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, hashed, and the hash of what they decode to."""
    path, pattern = byte_bpe.default_vocabulary()
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two to four words of each language that occur 30 times or more."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return page_density.main_texts(table(spark, sf_dir, "pages"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and put into fill-in-middle order, hashed, and the hash of what is restored from it."""
    return fim.digest(table(spark, sf_dir, "documents"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_bradley_terry_quality, op2_jump_hash_shards, op3_weak_toxicity, op4_trigram_secrets, op5_covering_simhash,
        op6_token_rollup, op7_window_decontamination, op8_voronoi_top_k, op9_weak_pii, op10_byte_bpe,
        op11_collocations, op12_text_density, op13_fill_in_middle,
    )
    return {f.__name__: f for f in found}


#: The same counts in the oracle's own regular expressions.
_WORDS_1, _WORDS_2 = r"[^ \t\n\x0B\f\r]+", r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x00-\x20]"
ORACLES = {
    "op6_token_rollup": rf"""
        with counted as (
            select source, lang,
                   len(regexp_extract_all(coalesce(text, ''), '{_WORDS_1}')) as n1,
                   len(regexp_extract_all(coalesce(text, ''), '{_WORDS_2}')) as n2
            from documents)
        select source, lang, 'words-1' as version, count(*) as docs, cast(sum(n1) as bigint) as tokens
        from counted group by source, lang
        union all
        select source, lang, 'words-2', count(*), cast(sum(n2) as bigint) from counted group by source, lang""",
    "op8_voronoi_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
            from embeddings
            where embedding is not null
              and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        scored as (
            select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
            from v q, v c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20""",
    "op11_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) as piece
            from documents),
        words as (select lang, regexp_extract_all(piece, '[^ \t]+') as w from pieces),
        totals as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
        grams as (
            select lang, size, unnest(list_transform(range(1, cast(len(w) - size + 2 as bigint)), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase
            from words, (values (1), (2), (3), (4)) as s(size) where len(w) >= size),
        f as (select lang, size, phrase, count(*) as n from grams group by all having count(*) >= 30),
        cand as (select lang, size, phrase, n as a, string_split(phrase, ' ') as w from f where size >= 2),
        cuts as (select *, unnest(range(1, size)) as k from cand),
        cut as (
            select c.lang, c.size, c.phrase, c.a, c.w, x.n as l, y.n as r, (2000000::hugeint * c.a) // (x.n + y.n) as score
            from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ')
            join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:], ' ')
            qualify row_number() over (partition by c.lang, c.phrase order by (2000000::hugeint * c.a) // (x.n + y.n), c.k) = 1),
        inside as (
            select o.lang, o.a as around, array_to_string(o.w[i:i + m - 1], ' ') as phrase
            from (select *, unnest(range(2, size)) as m from cand) o, unnest(range(1, o.size - o.m + 2)) as t(i)),
        kept as (select * from cut c where not exists (select 1 from inside i where i.lang = c.lang and i.phrase = c.phrase and 100::hugeint * i.around >= 80::hugeint * c.a))
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, cast(score as bigint) as score
        from kept join totals using (lang) qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000""",
    "op13_fill_in_middle": r"""
        with h as (
            select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
                   list_transform(range(0, 4), lambda i: cast(concat('0x', substr(sha256('1:' || doc_id), cast(1 + 8 * i as bigint), 8)) as bigint)) as h
            from documents),
        c as (
            select *, cast(len(u) as bigint) as n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as x, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) as y,
                   case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain'
                        when h[4] % 100 < 20 then 'spm' else 'psm' end as form
            from h),
        p as (select *, array_to_string(u[1:x], '') as prefix, array_to_string(u[x + 1:y], '') as middle, array_to_string(u[y + 1:], '') as suffix from c)
        select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256
        from p""",
}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
