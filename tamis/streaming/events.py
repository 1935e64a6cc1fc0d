"""Structured Streaming jobs: windowed counts, joins of two kinds of events, and first documents, over batches that commit once.

Each batch writes its own folder in overwrite mode, so a batch that runs again after a failure replaces itself. What a batch writes are partial sums, or pairs
with the rows of all batches up to it, so results are whole whatever the order in which files arrive, and nothing is late. `live_windows` and
`live_pairs` are the other kind: their state is bounded by a watermark, and events that come after it don't count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.session import Scratch


def _arrivals(spark: SparkSession, folder: str, glob: str, files_a_batch: int) -> DataFrame:
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def _run(rows: DataFrame, scratch: Scratch, mode: str, each: Callable[[DataFrame, int], DataFrame] | None = None) -> str:
    """Runs a stream over all that has arrived, `each` batch and its number turned into what it writes; the path of its batches."""
    spark, path, kept = rows.sparkSession, scratch.path("batches"), "spark.sql.streaming.numRecentProgressUpdates"

    def commit(batch: DataFrame, number: int) -> None:
        (each(batch, number) if each else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    before = spark.conf.get(kept)
    spark.conf.set(kept, "1000000")  # numbers of all batches, not of the last hundred
    try:
        query = rows.writeStream.foreachBatch(commit).outputMode(mode).option("checkpointLocation", scratch.path("checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(kept, before)
    done = [(p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution", 0)) for p in query.recentProgress]
    if done:
        spark.createDataFrame(done, "batch long, rows long, milliseconds long").coalesce(1).write.mode("overwrite").parquet(scratch.path("progress"))
    return path


def progress(scratch: Scratch) -> DataFrame:
    """(batch, rows, milliseconds) of the batches of a run that has ended."""
    return scratch.spark.read.parquet(scratch.path("progress"))


def _windowed(spark: SparkSession, folder: str, glob: str, files_a_batch: int, name: str, length: str, step: str | None) -> DataFrame:
    """(began, event_type, n, value) of windows: each batch writes its partial sums, which add up whatever batch an event came in."""
    window = F.window(F.col("ts").cast("timestamp"), length, step) if step else F.window(F.col("ts").cast("timestamp"), length)
    sums = lambda batch, number: batch.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    batches = spark.read.parquet(_run(_arrivals(spark, folder, glob, files_a_batch), Scratch(spark, name), "append", sums))
    whole = batches.groupBy("w", "event_type").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    return whole.select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n", "value")


def sliding(spark: SparkSession, folder: str, glob: str, files_a_batch: int = 100) -> DataFrame:
    """(began, event_type, n) of windows of six hours that begin every two."""
    return _windowed(spark, folder, glob, files_a_batch, "sliding", "6 hours", "2 hours").select("began", "event_type", "n")


def hourly(spark: SparkSession, folder: str, glob: str, files_a_batch: int = 100) -> DataFrame:
    """(hour, event_type, n, value) of tumbling hours."""
    whole = _windowed(spark, folder, glob, files_a_batch, "hourly", "1 hour", None)
    return whole.select(F.col("began").alias("hour"), "event_type", "n", F.round("value", 2).alias("value"))


def joined(spark: SparkSession, folder: str, glob: str, files_a_batch: int = 100) -> DataFrame:
    """(purchase, click) of a user's clicks in the hour before each purchase.

    A batch keeps its purchases and clicks, and writes its purchases' pairs with all clicks so far and its clicks' pairs with the purchases of
    earlier batches, so that each pair is written once. Clicks meet purchases by user and hour, in their own and the next one.
    """
    scratch = Scratch(spark, "joined")
    kept = scratch.path("rows")

    def pairs(purchases: DataFrame, clicks: DataFrame) -> DataFrame:
        hours = clicks.select(F.col("event_id").alias("click"), "user_id", F.col("ts").alias("clicked"), F.explode(F.array("hour", F.col("hour") + F.expr("interval 1 hour"))).alias("hour"))
        met = purchases.select(F.col("event_id").alias("purchase"), "user_id", "ts", "hour").join(hours, ["user_id", "hour"])
        return met.where("clicked <= ts and clicked >= ts - interval 1 hour").select("purchase", "click")

    def each(batch: DataFrame, number: int) -> DataFrame:
        batch.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        own = spark.read.schema(batch.schema).parquet(f"{kept}/batch={number}")
        before = spark.read.parquet(kept).where(F.col("batch") < number).drop("batch")
        bought, clicked = (lambda rows: rows.where("event_type = 'purchase'")), (lambda rows: rows.where("event_type = 'click'"))
        return pairs(bought(own), clicked(own.unionByName(before))).unionByName(pairs(bought(before), clicked(own)))

    rows = _arrivals(spark, folder, glob, files_a_batch).where("event_type in ('purchase', 'click')")
    rows = rows.select("event_id", "user_id", "ts", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return spark.read.parquet(_run(rows, scratch, "append", each)).select("purchase", "click")


def live_windows(spark: SparkSession, folder: str, glob: str, files_a_batch: int = 100) -> DataFrame:
    """(began, event_type, n) of windows of six hours that begin every two, under a watermark of a day; the latest row of a window counts."""
    events = _arrivals(spark, folder, glob, files_a_batch).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    counted = events.groupBy(F.window("ts", "6 hours", "2 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    rows = counted.select(F.col("w.start").cast("timestamp_ntz").alias("began"), "event_type", "n")
    batches = spark.read.parquet(_run(rows, Scratch(spark, "live-windows"), "update"))
    return batches.groupBy("began", "event_type").agg(F.max(F.struct("batch", "n"))["n"].alias("n"))


def live_pairs(spark: SparkSession, folder: str, glob: str, files_a_batch: int = 100) -> DataFrame:
    """(purchase, click) of a user's clicks in the hour before each purchase: two streams with watermarks, whose state is bounded by the hour."""
    side = lambda kind, name: (
        _arrivals(spark, folder, glob, files_a_batch)
        .where(F.col("event_type") == kind)
        .select(F.col("event_id").alias(name), F.col("user_id").alias(f"{name}_user"), F.col("ts").cast("timestamp").alias(f"{name}_ts"))
        .withWatermark(f"{name}_ts", "1 day")
    )
    near = F.expr("purchase_user = click_user and click_ts <= purchase_ts and click_ts >= purchase_ts - interval 1 hour")
    rows = side("purchase", "purchase").join(side("click", "click"), near).select("purchase", "click")
    return spark.read.parquet(_run(rows, Scratch(spark, "live-pairs"), "append")).select("purchase", "click")


def first_documents(spark: SparkSession, folder: str, glob: str, files_a_batch: int = 100) -> DataFrame:
    """(doc_id, source) of the best document of each text over all batches, by source number and id.

    Batches store a document's hash and rank only. A better-ranked document that arrives late displaces the one before it,
    so the result doesn't depend on the order of arrival.
    """
    # the glob names files, or folders of files; as a pattern of paths it finds both
    path = f"{folder}/{{{glob}}}"
    docs = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    rank = F.regexp_extract("source", "[0-9]+", 0).try_cast("int").alias("rank")
    rows = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("h"), rank, "doc_id", "source")
    batches = spark.read.parquet(_run(rows, Scratch(spark, "first"), "append"))
    return batches.groupBy("h").agg(F.min(F.struct("rank", "doc_id", "source")).alias("f")).select("f.doc_id", "f.source")
