"""Phrase collocations by language: contiguous phrases that occur more often than the parts they can be cut into.

All phrases of 1 to `longest` words become rows, are summed in the task that reads them and then hash-aggregated by language and
phrase. A phrase can only be frequent if all shorter ones in it are, so passes before it count the phrases of 2 words, then of 3, by a 40-bit
hash, and rows of phrases that hold one whose hash is too rare are left out. The hashes that are frequent enough travel as Bloom
filters of a fixed size: where one fills up, or hashes meet, more rows are counted than need be, but every count is that of
the words themselves. Counts of first parts and rests are joined to the candidates, scored in Decimal; candidates that a longer one by a word
explains go by an anti join; ranks come from a window over at most a bounded number of rows of each language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.session import Scratch

#: Where pieces end, and what parts words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Language of rows that have none.
UNKNOWN = "und"
#: Bytes of text that are counted at a time; a piece that is longer stays whole.
BLOCK = 1 << 21
#: Bits of a filter of frequent phrases, 8 MB whatever the input, and of the hashes that are counted.
FILTER_BITS, HASH_BITS = 26, 40
#: Spark cuts its bitmaps to so many bits.
SLICE = 1 << 15
#: Parts of each language that are ranked alone before the last ranking.
SALTS = 64

WORD, BLANK, BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(BREAKS)] = BLANK, BREAK
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
#: Odd multipliers of the hashes.
_R, _A, _B, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))

HASHES = "hash long, n long"
PHRASES = "lang string, size int, phrase string, n long"


def blocks(text: bytes) -> Iterator[bytes]:
    """Parts of about BLOCK bytes that end where a piece ends."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            last = max(text.rfind(bytes([b]), at, end) for b in BREAKS)
            if last < at:
                last = min((p for b in BREAKS if (p := text.find(bytes([b]), end)) >= 0), default=len(text))
            end = last + 1
        yield text[at:end]
        at = end


class Words:
    """The words of a block: their bytes one after another with a space between, where each starts, and which are in one piece with the next."""

    def __init__(self, text: bytes):
        data = _SMALL[np.frombuffer(text, np.uint8)]
        kind = _KIND[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind == WORD
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        self.sizes = ends - starts
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == BREAK, out=breaks[1:])
        self.joined = np.zeros(len(starts), bool)
        if len(starts):
            self.joined[:-1] = breaks[starts[1:]] == breaks[ends[:-1]]
        kept = inside[1:] | inside[:-1]  # the words' bytes and one after each
        self.bytes = np.append(data, 32).astype(np.uint8)[kept]
        self.starts = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(self.sizes + 1, out=self.starts[1:])
        self.bytes[self.starts[1:] - 1] = 32

    def hashes(self, lang: str) -> np.ndarray:
        """A 64-bit hash of each word, other ones in each language."""
        if not len(self.sizes):
            return np.zeros(0, np.uint64)
        powers = np.multiply.accumulate(np.full(int(self.sizes.max()) + 1, _R))
        within = np.arange(len(self.bytes), dtype=np.int32) - np.repeat(self.starts[:-1].astype(np.int32), self.sizes + 1)
        terms = powers[within]
        terms *= self.bytes
        terms[self.starts[1:] - 1] = 0
        words = np.add.reduceat(terms, self.starts[:-1]) + np.uint64(zlib.crc32(lang.encode()))
        return (words ^ (words >> np.uint64(29))) * _MIX

    def strings(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of so many words from the given words on."""
        begin, last = self.starts[at], at + size - 1
        lengths = self.starts[last] + self.sizes[last] - begin
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        places = np.repeat(begin - offsets[:-1], lengths) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(self.bytes[places])])


def places(hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in a filter."""
    return hash_ & ((1 << FILTER_BITS) - 1), hash_ >> (HASH_BITS - FILTER_BITS)


def possible(words: Words, lang: str, filters: list[np.ndarray], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For sizes from 1 on: whether a phrase that may be frequent begins at each word, and its hash. `filters` are those of sizes 2, 3, ..."""
    holds, hashes = np.ones(len(words.sizes), bool), words.hashes(lang)
    for size in range(1, longest + 1):
        if size > 1:
            # a longer phrase is two shorter ones that overlap in all but their ends; pairs only overlap in being of one piece
            after = np.zeros(len(holds), bool)
            after[:-1] = holds[1:]
            holds = holds & after & words.joined
            hashes = hashes * _A + np.roll(hashes, -1) * _B
            hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
            hashes ^= hashes >> np.uint64(29)
        at = (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        if 1 < size < len(filters) + 2:
            one, two = places(at)
            bit = lambda p, f=filters[size - 2]: (f[p >> 3] >> (p & 7)) & 1
            holds = holds & (bit(one) & bit(two)).astype(bool)
        yield size, holds, at


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Blocks of each language's texts; a break stands between two texts."""
    langs = batch.column(0)
    for lang in pc.unique(langs).to_pylist():
        own = batch.column(1).filter(pc.equal(langs, lang))
        for block in blocks(b"\n".join(own.cast(pa.large_binary()).to_pylist())):
            yield lang, block


def hash_rows(lang: str, block: bytes, filters: list[np.ndarray]) -> pa.RecordBatch:
    """(hash, n) of a block's phrases that are one word longer than those of the last filter."""
    *_, (_, holds, hashes) = possible(Words(block), lang, filters, len(filters) + 2)
    hash_, n = np.unique(hashes[holds], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(hash_), pa.array(n.astype(np.int64))], names=["hash", "n"])


def phrase_rows(lang: str, block: bytes, filters: list[np.ndarray], longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, size, phrase, n) of a block's words, of its longer phrases that the filters let through, and, as size 0, its number of words."""
    words = Words(block)
    names = ["lang", "size", "phrase", "n"]

    def row(size: int, phrases: pa.Array, n: pa.Array) -> pa.RecordBatch:
        sizes = pa.array(np.full(len(phrases), size, np.int32))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), sizes, phrases.cast(pa.string()), n.cast(pa.int64())], names=names)

    yield row(0, pa.array([""]), pa.array([len(words.sizes)]))
    for size, holds, _ in possible(words, lang, filters, longest):
        at = np.flatnonzero(holds)
        if not len(at):
            return
        counted = pc.value_counts(words.strings(at, size))
        yield row(size, counted.field(0), counted.field(1))


def frequent_hashes(rows: DataFrame, least: int, sent: list) -> bytes:
    """The filter of phrases one word longer than those of the last of the filters `sent`: two bits for each hash that occurs `least` times or
    more. 8 MB at most reach the driver."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [np.frombuffer(f.value, np.uint8) for f in sent]
        for batch in batches:
            for lang, block in _texts(batch):
                yield hash_rows(lang, block, filters)

    counted = rows.mapInArrow(hashed, HASHES).groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    one, two = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), F.shiftright("hash", HASH_BITS - FILTER_BITS)
    bits = counted.select(F.explode(F.array(one + 1, two + 1)).alias("bit"))  # Spark's slices begin with bit 1
    made = bits.groupBy(F.bitmap_bucket_number("bit").alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = bytearray((1 << FILTER_BITS) // 8)
    for r in made.collect():
        out[(r["slice"] - 1) * (SLICE // 8) : r["slice"] * (SLICE // 8)] = r["bits"]
    return bytes(out)


def counts(docs: DataFrame, least: int, longest: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, size, phrase, n) of all phrases of 1 to `longest` words that occur `least` times or more; size 0 has a language's number of words."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sent: list = []
    while len(sent) < longest - 2:
        sent.append(docs.sparkSession.sparkContext.broadcast(frequent_hashes(rows, least, sent)))

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [np.frombuffer(f.value, np.uint8) for f in sent]
        for batch in batches:
            for own, block in _texts(batch):
                yield from phrase_rows(own, block, filters, longest)

    summed = rows.mapInArrow(exploded, PHRASES).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return summed.where((F.col("n") >= least) | (F.col("size") == 0))


def _decimal(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def scored(counted: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """(lang, phrase, size, a, k, l, r, score) of phrases of two words or more, at the cut of the least score, of ties the first."""
    word = F.split("phrase", " ")
    join = lambda first, n: F.array_join(F.slice(word, first, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), join(F.lit(1), k).alias("first"), join(k + 1, F.col("size") - k).alias("rest")))
    each = counted.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "size", "a", "c.*")
    known = counted.where("size >= 1")
    each = each.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    each = each.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return each.groupBy("lang", "phrase", "size", "a").agg(least).select("lang", "phrase", "size", "a", "cut.*")


def unexplained(candidates: DataFrame, percent: int = 80) -> DataFrame:
    """Candidates without a longer one around them that occurs `percent` % as often. Of longer ones some extension by a single word occurs as
    often as they do at least, so those by one word decide."""
    word, size = F.split("phrase", " "), F.col("size")
    inner = F.array(F.array_join(F.slice(word, F.lit(1), size - 1), " "), F.array_join(F.slice(word, F.lit(2), size - 1), " "))
    longer = candidates.where("size >= 3").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("around"))
    most = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around")).alias("x")
    own = candidates.alias("c")
    same = (F.col("c.lang") == F.col("x.lang")) & (F.col("c.phrase") == F.col("x.phrase"))
    return own.join(most, same & (_decimal("x.around") * 100 >= _decimal("c.a") * percent), "left_anti")


def top(rows: DataFrame, most: int) -> DataFrame:
    """Each language's first `most` rows with their rank. Parts of a language are ranked first, so that the last window sees a bounded number of rows."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    part = rows.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= most)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("salt", "place")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, percent: int = 80, most: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    Null and empty texts have no words; null languages are `und`, one with rows so named; repeated rows count each; ties go by
    occurrences and then by the phrase's bytes; other columns are ignored; an empty table, and languages without a frequent phrase, give no rows.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counted = scratch.keep(counts(docs, least, longest, lang, text), "counts")
    candidates = scratch.keep(scored(counted), "candidates")
    total = counted.where("size = 0").select("lang", "n")
    ranked = top(unexplained(candidates, percent), most)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
