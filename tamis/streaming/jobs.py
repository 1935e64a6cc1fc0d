"""Keyed state over a stream: jobs with retries, and results that are committed in the order of their ranks.

State is a table of a batch's number: a batch merges the state after the one before it with its rows, by joins and sums over all keys at once, and writes the next.
A run that was killed goes on where the last whole batch ended, as its checkpoint says. State and output go to a folder for each batch, so a batch that runs again
replaces itself; of states the last two stay. A key costs no call of its own, and a key's rows are sorted, not held, by the task that has them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The store for streams that keep state in Spark's own.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def run(rows: DataFrame, folder: str, state: str, step: Callable[[DataFrame, DataFrame], DataFrame], out: Callable[[DataFrame], DataFrame], before: Callable[[int], None] | None = None) -> DataFrame:
    """Runs a stream over what has arrived, from where the folder's checkpoint ended; what all batches so far gave, with `batch`.

    `step` makes the state after a batch from the state before it and its rows, in the schema `state`; `out` picks from a written state what the batch gives.
    `before` is called with each batch's number before it is written.
    """
    spark = rows.sparkSession
    kept = lambda number: f"{folder}/state/{number}"

    def commit(batch: DataFrame, number: int) -> None:
        if before:
            before(number)
        known = spark.read.schema(state).parquet(kept(number - 1)) if number else spark.createDataFrame([], state)
        step(known, batch).write.mode("overwrite").parquet(kept(number))
        out(spark.read.schema(state).parquet(kept(number))).write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")
        if number > 1:
            target, files = _files(spark, kept(number - 2))
            files.delete(target, True)

    query = rows.writeStream.foreachBatch(commit).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/batches")


def attempts(events: DataFrame, folder: str, most: int = 3, before: Callable[[int], None] | None = None) -> DataFrame:
    """(user_id, tries, state, seen) of a stream of events (user_id, ts, event_id, event_type): a purchase ends a user's job well, an error is a try, after `most`
    tries it is given up. The last batch that touched a user counts. Late and unordered events change the verdict as if they had come in time.

    The state are a user's first tries by time and number, `most` at most, each with how many rows it stands for and whether the batch touched the user.
    """
    tries = events.where("event_type in ('purchase', 'error')").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") == "purchase").alias("done"))
    first = Window.partitionBy("user_id").orderBy("ts", "event_id", "done")

    def step(known: DataFrame, batch: DataFrame) -> DataFrame:
        every = known.select("user_id", "ts", "event_id", "done", F.lit(False).alias("new")).unionByName(batch.withColumn("new", F.lit(True)))
        once = every.groupBy("user_id", "ts", "event_id", "done").agg(F.max("new").alias("new"))
        top = once.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).drop("new")
        seen = known.where("place = 1").select("user_id", "seen", F.lit(False).alias("new")).unionByName(batch.select("user_id", F.lit(1).cast("long").alias("seen"), F.lit(True).alias("new")))
        counts = seen.groupBy(F.col("user_id").alias("user")).agg(F.sum("seen").alias("seen"), F.max("new").alias("touched"))
        return top.join(counts, F.col("user_id").eqNullSafe(F.col("user"))).drop("user")

    def out(state: DataFrame) -> DataFrame:
        by = state.where("touched").groupBy("user_id").agg(F.min(F.when(F.col("done"), F.col("place"))).alias("won"), F.max("place").alias("n"), F.max("seen").alias("seen"))
        name = F.when(F.col("won").isNotNull(), "accepted").when(F.col("n") >= most, "given_up").otherwise("open")
        return by.select("user_id", F.coalesce("won", "n").cast("long").alias("tries"), name.alias("state"), "seen")

    every = run(tries, folder, "user_id long, ts timestamp, event_id long, done boolean, place int, seen long, touched boolean", step, out, before)
    return every.groupBy("user_id").agg(F.max_by(F.struct("tries", "state", "seen"), "batch").alias("s")).select("user_id", "s.*")


def in_rank(items: DataFrame, folder: str, before: Callable[[int], None] | None = None) -> DataFrame:
    """(grp, rank, item, batch) of a stream of (grp, rank, item): results of a group that come in any order go out in that of their ranks, 0, 1, 2, ...: each rank once,
    and in the first batch by which all ranks before it had come. A rank that comes again is dropped.

    The state are rows that wait, rows that the batch sends out, and of each group one row with the rank that it waits for (item is null).
    """

    def step(known: DataFrame, batch: DataFrame) -> DataFrame:
        heads = known.where("kind = 'next'").select(F.col("grp").alias("g"), F.col("rank").alias("next"))
        old = known.where("kind = 'waiting'").select("grp", "rank", "item", F.lit(0).alias("age"))
        every = old.unionByName(batch.select("grp", "rank", "item", F.lit(1).alias("age"))).groupBy("grp", "rank").agg(F.min(F.struct("age", "item"))["item"].alias("item"))
        open_ = every.join(heads, F.col("grp").eqNullSafe(F.col("g")), "left").drop("g").withColumn("next", F.coalesce("next", F.lit(0).cast("long"))).where("rank >= next")
        # a group's run ends before the first rank whose place in it, counted from where it waits, falls short
        placed = open_.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("rank")) - 1)
        rows = placed.select("grp", "rank", "item", F.when(F.col("rank") == F.col("next") + F.col("place"), "out").otherwise("waiting").alias("kind"))
        sent = rows.where("kind = 'out'").groupBy("grp").agg((F.max("rank") + 1).alias("rank"))
        after = heads.select(F.col("g").alias("grp"), F.col("next").alias("rank")).unionByName(sent).groupBy("grp").agg(F.max("rank").alias("rank"))
        return rows.unionByName(after.select("grp", "rank", F.lit(None).cast("long").alias("item"), F.lit("next").alias("kind")))

    return run(items, folder, "grp long, rank long, item long, kind string", step, lambda state: state.where("kind = 'out'").select("grp", "rank", "item"), before)


def with_store(spark: SparkSession) -> Callable[[], None]:
    """Sets the state store for the streams that start next; the function that puts back what was set before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    return lambda: spark.conf.set(name, before) if before else spark.conf.unset(name)
