"""JSON lines: a scan that keeps what it can't read as rows with a reason, and a sink of bounded files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tamis.session import Scratch

BROKEN = "__broken"


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The fields of each line, plus `reason` ('bad_json' or null) and `raw_bytes` of a bad line. Blank lines are skipped; gz by suffix."""
    whole = StructType([*schema.fields, *StructType().add(BROKEN, "string").fields])
    lines = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).json(path)
    bad = F.col(BROKEN).isNotNull()
    return lines.select(*schema.names, F.when(bad, F.lit("bad_json")).alias("reason"), F.octet_length(BROKEN).alias("raw_bytes"))


def write(rows: DataFrame, path: str, rows_a_file: int = 200_000) -> None:
    """Compressed files of at most so many rows each."""
    rows.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", rows_a_file).json(path)


def round_trip_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(source, docs, bytes) of what comes back from a written copy with one broken line; bad lines count under 'bad_json'."""
    scratch = Scratch(spark, "jsonl")
    write(docs, scratch.path("lines"))
    spark.createDataFrame([('{"doc_id": 1, "x',)], "value string").coalesce(1).write.mode("append").text(scratch.path("lines"))
    back = read(spark, scratch.path("lines"), docs.schema)
    size = F.coalesce("raw_bytes", F.octet_length("text"))
    return back.groupBy(F.coalesce("reason", "source").alias("source")).agg(F.count("*").alias("docs"), F.sum(size).cast("long").alias("bytes"))
