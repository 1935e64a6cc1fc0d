"""Streams over several batches in any order of time, and runs that are killed and start again."""

import pytest
from pyspark.sql import functions as F

from tamis.streaming import events as stream
from tamis.streaming import jobs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    folder = str(tmp_path_factory.mktemp("arriving") / "events")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(folder)
    return events, folder


@pytest.fixture
def store(spark):
    back = jobs.with_store(spark)
    yield
    back()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("job", [stream.hourly, stream.sliding, stream.joined])
def test_batches_in_any_order_give_what_one_gives(spark, arriving, job):
    _, folder = arriving
    assert rows_of(job(spark, folder, "*.parquet", 1)) == rows_of(job(spark, folder, "*.parquet", 100))


def test_progress_names_every_batch(spark, arriving):
    from tamis.session import Scratch

    scratch = Scratch(spark, "progress")
    stream._run(stream._arrivals(spark, arriving[1], "*.parquet", 1), scratch, "append")
    got = stream.progress(scratch)
    assert got.count() == 4 and got.agg(F.sum("rows")).head()[0] == arriving[0].count()


class Killed(Exception):
    pass


def killer(at):
    """Ends a run just before its batch `at` is written, once."""
    left = [at]

    def before(number):
        if left and number == left[0]:
            left.clear()
            raise Killed

    return before


def run_twice(rows, job, folder):
    kill = killer(2)
    with pytest.raises(Exception, match="Killed"):
        job(rows(), folder, before=kill)
    return job(rows(), folder, before=kill)


def test_tries_survive_a_restart(spark, arriving, store, tmp_path):
    events, folder = arriving
    rows = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    whole = rows_of(jobs.attempts(rows(), str(tmp_path / "whole")))
    assert rows_of(run_twice(rows, jobs.attempts, str(tmp_path / "killed"))) == whole
    want = {}
    for r in events.where("event_type in ('purchase', 'error')").orderBy("ts", "event_id").collect():
        tries, state, seen = want.get(r.user_id, (0, "open", 0))
        if state == "open":
            tries += 1
            state = "accepted" if r.event_type == "purchase" else "given_up" if tries == 3 else "open"
        want[r.user_id] = tries, state, seen + 1
    assert {u: s for u, *s in whole} == {u: list(s) for u, s in want.items()}


def test_ranks_go_out_in_order_also_after_a_restart(spark, store, tmp_path):
    items = [(g, r, 100 * g + r) for g in range(3) for r in range(8)] + [(7, 1, 701)]
    df = spark.createDataFrame(items, "grp long, rank long, item long")
    for number, part in enumerate([F.col("rank") % 3 == 2, F.col("rank") % 3 == 0, F.col("rank") % 3 == 1, F.col("rank") < 2]):  # the last one again
        df.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/{number}"))
    rows = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = run_twice(rows, jobs.in_rank, str(tmp_path / "killed"))
    assert rows_of(got.select("grp", "rank", "item")) == sorted(items[:-1])  # 7's rank 0 never came
    for g in range(3):
        batches = [r.batch for r in got.where(F.col("grp") == g).orderBy("rank").collect()]
        assert batches == sorted(batches) and len(set(batches)) > 1


def test_first_documents_also_come_from_a_folder_of_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = rows_of(stream.first_documents(spark, SMALL, "documents.parquet"))
    assert len(want) > 0
    assert rows_of(stream.first_documents(spark, str(tmp_path), "documents.parquet", 1)) == want


def test_streamed_state_calls_no_python_for_a_key(spark, tmp_path):
    """Groups that are null or come again, and many groups: as many rows as went in, each once."""
    import time

    df = spark.range(200_000).select(F.when(F.col("id") >= 10, F.floor(F.col("id") / 10)).alias("grp"), (F.col("id") % 10).alias("rank"), F.col("id").alias("item"))
    df.repartition(3, F.xxhash64("item")).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    began = time.monotonic()
    got = jobs.in_rank(rows, str(tmp_path / "run")).agg(F.count("*"), F.countDistinct("item"), F.count_if(F.col("grp").isNull())).head()
    assert tuple(got) == (200_000, 200_000, 10)
    assert time.monotonic() - began < 120  # a call for each group and batch takes longer
