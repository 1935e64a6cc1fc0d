"""Near-duplicates by covering tables: SimHash fingerprints within a Hamming radius of 2, and whole texts by shingle similarity.

Covering tables: give each of the 64 bits one of the seven non-zero vectors of GF(2)^3, in turn. The table of a non-zero
vector v keeps the bits whose vector has an odd product with v, 36 or 37 of them. Two differing bits leave at least one v
with even products to both, so any pair within the radius agrees on all the kept bits of some table.

Links inside a bucket are found through meeting points instead of pairs. Bucket mates within the radius differ outside the
kept bits only, so they share a word at distance 1 or less from both, and any two fingerprints that reach one word are within 2
of each other. Linking everyone who reaches a word to the least of them is thus exact, and linear in the bucket's size.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tamis.operators import minhash
from tamis.operators.components import connected_components
from tamis.session import Scratch

BITS, RADIUS, SHINGLE_WORDS = 64, 2, 3
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 14
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table_masks(radius: int = RADIUS) -> list[int]:
    """Masks of the covering tables as unsigned words; 2^(radius+1) - 1 of them."""
    vectors = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if (i % vectors + 1 & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def text_fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash: a bit is 1 if it is set in over half the shingle hashes; no words give 0."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    if len(found) < words:
        return _signed(xxhash.xxh64_intdigest(b" ".join(found), 42))
    n = len(found) - words + 1
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([text_fingerprint(t) for t in texts], dtype="int64")


def links(fingerprints: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct longs in `fp` -> (u, v): pairs within the radius that connect all that are linked, directly or by others."""
    masks = [_signed(m) for m in table_masks()]
    keyed = fingerprints.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))).alias("at")).select("fp", "at.t", "at.key")
    shared = scratch.keep(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key"), "shared-buckets")
    flips = [[_signed(1 << i) for i in range(BITS) if not m >> i & 1] for m in table_masks()]
    reach = F.element_at(F.array(*(F.array(*(F.lit(x) for x in (0, *own))) for own in flips)), F.col("t") + 1)
    met = keyed.join(shared, ["t", "key"], "left_semi").select("fp", F.explode(reach).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")).distinct()
    met = scratch.keep(met, "meeting-words")
    heads = scratch.keep(met.groupBy("word").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").select("word", "head"), "heads")
    found = scratch.keep(met.join(heads, "word").where("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v")).distinct(), "links")
    scratch.drop("shared-buckets", "meeting-words", "heads")
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, fp (signed), fingerprint (hex), component_id (the least key linked to it, itself included).

    Null and wordless texts have fingerprint 0 and link like any other. Copies collapse to one node before any search, so a
    large group of them costs no more than a small one; repeated rows and null keys stay as rows (null keys are never an id).
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(docs.select(F.col(key).alias("doc_id"), fingerprint(F.col(text)).alias("fp")), "marked")
    nodes = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    members = connected_components(links(nodes.select("fp"), scratch), scratch)
    roots = members.unionByName(members.select(F.col("v").alias("u"), "v").distinct())
    roots = scratch.keep(roots.join(nodes, F.col("u") == F.col("fp")).select("u", "v", "least"), "roots")
    classes = scratch.keep(roots.groupBy("v").agg(F.min("least").alias("component_id")), "classes")
    linked = scratch.keep(roots.join(classes, "v").select(F.col("u").alias("fp"), "component_id"), "linked")
    named = scratch.keep(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return marked.join(named, "fp").select("doc_id", "fp", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _hex(word: Column) -> Column:
    return F.lower(F.lpad(F.hex(word), 16, "0"))


def covering_layout(groups: int = 9, size: int = 9, radius: int = 1, words: int = 5, least: float = 0.8) -> minhash.Layout:
    """The covering tables of the SimHash bits, by which texts within its radius meet for certain, and the same masks over the places of a sketch for what
    lies beyond: each of the groups has covering tables of its own.

    Texts whose sketches differ in groups * (radius + 1) - 1 places at most differ in `radius` places at most in some group, and so
    meet in a table for certain; beyond that most do.
    """
    vectors = (1 << radius + 1) - 1
    kept = [tuple(i for i in range(size) if (i % vectors + 1 & v).bit_count() & 1) for v in range(1, vectors + 1)]
    return minhash.Layout(tuple(tuple(g * size + i for i in own) for g in range(groups) for own in kept), words, least, tuple(table_masks()))


#: For whole texts of five-word similarity 0.8: a pair at the bound differs in 16 of 81 places on average; it meets for certain up
#: to 17, and in all with a probability of 0.998. Of the 64 bits of a SimHash such a pair differs in 9.7, which tables of a key long
#: enough for a large corpus can't cover, so texts are compared by places and not by bits here.
TEXTS = covering_layout()


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", layout: minhash.Layout = TEXTS) -> DataFrame:
    """One row of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, with its columns.

    Covering tables propose pairs, exact similarity decides, links connect. The row with the least key stays; rows without a key
    come last; of rows that repeat key and text one stays. Null, empty and wordless texts are their own only shingle: equal ones are
    copies. Columns may have any names. An empty table gives no rows.
    """
    return minhash.representatives(docs, key, text, layout)
