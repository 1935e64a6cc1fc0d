"""Every operator over tables without rows, and over tables of nulls only."""

import pytest
from pyspark.sql import functions as F

from tamis.llm import byte_bpe, collocations, decontaminate, fim, knn, page_density, pii, quality, secrets, sharding, simhash, token_rollup, toxicity

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
OPERATORS = {
    "quality": lambda d, x: quality.scores(d, x["labels"], F.lit(True)),
    "sharding": lambda d, x: sharding.assign_shards(d, 24),
    "toxicity": lambda d, x: toxicity.scores(d, x["labels"], F.lit(True)),
    "secrets": lambda d, x: secrets.digest(d),
    "simhash": lambda d, x: simhash.near_duplicates(d),
    "decontaminate": lambda d, x: decontaminate.contamination(d, x["benchmark"]),
    "pii": lambda d, x: pii.digest(d),
    "byte_bpe": lambda d, x: byte_bpe.round_trip(d, *byte_bpe.default_vocabulary()),
    "fim": lambda d, x: fim.digest(d),
}


@pytest.fixture(scope="module")
def others(spark):
    return {"labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([], "item_id long, text string")}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows_and_nulls_only(spark, others, name):
    nulls = spark.createDataFrame([(None,) * 5] * 3, FIELDS)
    assert OPERATORS[name](nulls.limit(0), others).count() == 0
    found = OPERATORS[name](nulls, others).collect()
    assert len(found) == 3 and len(set(map(repr, found))) in (1, 3)  # alike, but for a shard's slots


def test_other_tables_without_rows(spark):
    docs = spark.createDataFrame([(None,) * 5] * 3, FIELDS)
    assert collocations.collocations(docs).count() == 0
    pages = spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")
    assert [tuple(r) for r in page_density.main_texts(pages).collect()] == [(None, None, "", 0)]
    vectors = spark.createDataFrame([(None, None), (20, None)], "vec_id long, embedding array<float>")
    assert knn.top_k(vectors, F.col("vec_id") % 20 == 0).count() == 0 == knn.top_k(vectors.limit(0), F.lit(True)).count()
    counts = token_rollup.measured(docs, {"v": F.lit(2).cast("long")})
    assert [tuple(r) for r in token_rollup.inserted(token_rollup.by_version(counts, {"v": {"tokens": "n_0"}})).collect()] == [(None, None, "v", 1, 2)] * 3
