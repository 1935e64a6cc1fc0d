"""Every query outside llm that has an oracle, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tamis import plans
from tamis.functions import text as T
from tamis.operators import dedup, sampling


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query_equals_its_oracle(spark, sf_dir, sql, name):
    got = plans.registry()[name](spark, sf_dir)
    want = sql.sql(plans.oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    places = [want.columns.index(c) for c in sorted(want.columns)]
    rows = sorted(repr(tuple(plain(r[c]) for c in sorted(got.columns))) for r in got.collect())
    assert rows == sorted(repr(tuple(plain(r[i]) for i in places)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.registry()) - set(plans.oracles())))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert plans.registry()[name](spark, sf_dir).count() > 0


def test_gates_fail_in_order(spark):
    english = "the cat and the dog are in the house with all of them " * 5
    rows = [("", "empty"), (None, "empty"), ("short", "too_short"), ("пример текста " * 20, "non_ascii"), ("lorem ipsum dolor " * 20, "not_english"), (english, None)]
    df = spark.createDataFrame(rows, "text string, want string")
    assert df.where(~T.hygiene_reason(df["text"]).eqNullSafe(df["want"])).count() == 0
    # 200 bytes pass, 199 don't; bytes count, not characters
    edge = spark.createDataFrame([("the " * 49 + "thex",), ("the " * 49 + "the",), ("the " * 48 + "thé éé",)], "text string")
    assert [r[0] for r in edge.select(T.hygiene_reason(edge["text"])).collect()] == [None, "too_short", None]


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = None
    for n in (1, 7, 64):
        rows = docs.repartition(n)
        kept = sorted(tuple(r) for r in dedup.first_by(rows, rows["text"], ["doc_id"], ["doc_id", "source"]).collect())
        picked = sorted(tuple(r) for r in sampling.seeded_limit(rows.select("doc_id", "source"), "source", "doc_id", "s", 2).collect())
        assert want in (None, (kept, picked))
        want = kept, picked


def test_prefix_takes_the_shorter_of_equally_close(spark):
    rows = spark.createDataFrame([("g", 1, 10), ("g", 2, 10), ("g", 3, 10)], "g string, id int, size int")
    assert [tuple(r) for r in sampling.closest_prefix(rows, "g", ["id"], "size", 15.0).collect()] == [("g", 1, 10)]


def test_gates_read_whole_texts(spark):
    english, foreign, junk = "the cat and the dog are in the house " * 6000, "пример текста " * 16000, "lorem ipsum dolor " * 150000
    rows = [(english + foreign, "non_ascii"), (english + junk, "not_english"), (foreign + english * 5, None)]
    df = spark.createDataFrame(rows, "text string, want string")
    assert len(english) > 200_000 < len(foreign)
    assert df.where(~T.hygiene_reason(df["text"]).eqNullSafe(df["want"])).count() == 0
