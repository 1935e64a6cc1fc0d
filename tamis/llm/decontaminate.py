"""Benchmark decontamination by a broadcast hash set of word windows, in DataFrame functions only.

Benchmark texts become windows of ten words (a shorter item is one window of its own length). Each training position's
window is hashed and probed against the set; a hit counts only if the words themselves are equal. The set is broadcast as long as
its words and item ids take at most `most_broadcast` bytes. Beyond that narrow rows go through an exchange instead, where a
very frequent window can be split: key, place and two independent 64-bit hashes of a window, and a hit needs both.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.names import free_name
from tamis.session import Scratch

WINDOW, SALT = 10, 71
#: Fixed value: what separates words, once letters A-Z are small.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before that, for cutting texts that keep their case.
RAW_GAP, RAW_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words and item ids that may be sent to each executor.
MOST_BROADCAST = 64 << 20


def words(text: Column) -> Column:
    """Words of a text, A-Z made small and no other letter; null and wordless texts give an empty array."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    small = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, SMALL))
    return F.filter(F.split(small, GAP), lambda w: w != "")


def windows(found: Column, length: int) -> Column:
    """All windows of so many words, in order; none if there are fewer words."""
    last = F.size(found) - length
    return F.when(last < 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(found, i + 1, length)))


def hashed(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def window_hashes(word_hashes: Column, length: int, salt: int | None = None) -> Column:
    """A hash for each window, made from its words' hashes; with a salt another one."""
    last = F.size(word_hashes) - length
    of = lambda i: F.slice(word_hashes, i + 1, length)
    made = lambda i: F.xxhash64(of(i)) if salt is None else F.xxhash64(F.lit(salt), of(i))
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), last), made))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(hash, check, length, gram, items): each distinct window with the items that hold it. Items without words have none."""
    found = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    short = F.when(F.size("w") < window, F.array("w")).otherwise(windows(F.col("w"), window))
    return (
        found.select("item", F.explode(short).alias("gram"))
        .groupBy("gram")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(F.xxhash64(hashed(F.col("gram"))).alias("hash"), F.xxhash64(F.lit(SALT), hashed(F.col("gram"))).alias("check"), F.size("gram").alias("length"), "gram", "items")
    )


def _covered(spans: Column) -> Column:
    """How many words lie in sorted (at, length) spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, span: Column) -> Column:
        end = F.greatest(acc["end"], span["at"] + span["length"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], span["at"])).alias("n"), end.alias("end"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def find_hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(key, sig, spans, items) of each document with a hit; spans are sorted (at, length) in words, items sorted strings.

    `sig` is a hash of the text, so that rows that share a key but not a text stay apart. Null item ids count as no item.
    """
    grams = scratch.keep(benchmark_windows(benchmark), "windows")
    weight = F.aggregate(F.concat("gram", "items"), F.lit(16).cast("long"), lambda n, w: n + F.octet_length(w) + 8)
    size = grams.groupBy("length").agg(F.sum(weight).alias("bytes")).collect()  # one row for each length from 1 to the window
    lengths = sorted(r["length"] for r in size)
    if not lengths:
        empty = "key {}, sig long, spans array<struct<at:int,length:int>>, items array<string>".format(docs.schema[key].dataType.simpleString())
        return docs.sparkSession.createDataFrame([], empty)
    small = sum(r["bytes"] for r in size) <= most_broadcast
    base = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("sig"), words(F.col(text)).alias("w")).withColumn("h", hashed(F.col("w")))
    # columns of their own, so that exploding and probing stay in generated code and `w` isn't copied for each window; outer, since
    # else Spark tests the array's size below and works out the words' hashes again for each window
    if len(lengths) > 1:  # one pass over the text for all lengths: a row for each, then one for each window
        of = F.array(*(F.struct(F.lit(n).alias("length"), window_hashes(F.col("h"), n).alias("hashes"), *([] if small else [window_hashes(F.col("h"), n, SALT).alias("checks")])) for n in lengths))
        base = base.select("key", "sig", "w", F.explode_outer(of).alias("of")).select("key", "sig", "w", "of.*")
    else:
        own = [window_hashes(F.col("h"), lengths[0]).alias("hashes"), *([] if small else [window_hashes(F.col("h"), lengths[0], SALT).alias("checks")])]
        base = base.select("key", "sig", "w", F.lit(lengths[0]).alias("length"), *own)
    if small:
        at = base.select("key", "sig", "w", "length", F.posexplode_outer("hashes").alias("at", "hash"))
        known = F.broadcast(grams.select("hash", F.col("length").alias("its"), "gram", "items"))
        same = (F.col("length") == F.col("its")) & (F.slice("w", F.col("at") + 1, F.col("length")) == F.col("gram"))
        hits = at.join(known, "hash").where(same)
    else:
        at = base.select("key", "sig", "length", F.posexplode_outer(F.arrays_zip("hashes", "checks")).alias("at", "z"))
        at = at.select("key", "sig", "length", "at", F.col("z.hashes").alias("hash"), F.col("z.checks").alias("check")).where("hash is not null")
        hits = at.join(grams.select("hash", "check", "length", "items"), ["hash", "check", "length"])
    hits = hits.select("key", "sig", F.struct("at", "length").alias("span"), "items")
    return hits.groupBy("key", "sig").agg(
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """A row per document: key, n_words, n_hit, n_items, items, contaminated, spans.

    Null, empty and wordless texts: no words, no hits. Repeated rows each get their row; null keys are kept. An empty
    benchmark leaves every document clean. Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    hits = scratch.keep(find_hits(docs, benchmark, scratch, key, text, most_broadcast), "hits")
    base = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("sig"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    hits = hits.withColumnRenamed("key", "hit_key").withColumnRenamed("sig", "hit_sig")
    joined = base.join(hits, F.col("key").eqNullSafe(F.col("hit_key")) & (F.col("sig") == F.col("hit_sig")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.col("spans").isNotNull().alias("contaminated"),
        "spans",
    )


def remove(docs: DataFrame, benchmark: DataFrame, columns: Iterable[str], key: str = "doc_id", text: str = "text", most_share: float = 0.5) -> DataFrame:
    """The documents without what the benchmark holds, with the columns asked for, whatever other columns are named.

    A document of which more than `most_share` of the words are hit goes; from others the hit words go, each with what
    separates it from the next word, and the rest of the text stays as it was. Clean documents are not changed, nor are null, empty
    and wordless texts, or any without a benchmark. Repeated rows and null keys are judged one by one. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    hits = scratch.keep(find_hits(docs, benchmark, scratch, key, text), "hits")
    its_key, its_sig, its_spans = (free_name(n, docs) for n in ("hit_key", "hit_sig", "hit_spans"))
    hits = hits.select(F.col("key").alias(its_key), F.col("sig").alias(its_sig), F.col("spans").alias(its_spans))
    joined = docs.join(hits, F.col(key).eqNullSafe(F.col(its_key)) & (F.xxhash64(text) == F.col(its_sig)), "left")
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"({RAW_WORD}+{RAW_GAP}*)"), 1)
    hit = lambda i: F.exists(its_spans, lambda s: (i >= s["at"]) & (i < s["at"] + s["length"]))
    rest = F.concat(F.regexp_extract(text, f"^{RAW_GAP}*", 0), F.array_join(F.filter(pieces, lambda p, i: ~hit(i)), ""))
    share = _covered(F.col(its_spans)) / F.size(words(F.col(text)))
    kept = joined.where(F.col(its_spans).isNull() | (share <= most_share))
    return kept.withColumn(text, F.when(F.col(its_spans).isNull(), F.col(text)).otherwise(rest)).select(*columns)
