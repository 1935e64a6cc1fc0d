"""Readers of raw corpora: files by prefix, trees of messages, instruction rows, post dumps, tab-separated seeds, and shards of tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import cleaning, grams, text

MESSAGE = "tree string, id string, parent string, place int, role string, lang string, text string, rank int, deleted boolean, synthetic boolean, review boolean, spam double, state string"


def discover(spark: SparkSession, root: str, sources: dict[str, str], suffix: str = "*") -> DataFrame:
    """(source, path, bytes) of all files below a folder, by the first prefix of the path below it that fits; other files are left out.

    Nothing is read but the listing: contents are pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(root)
    below = F.regexp_extract("path", r"^(?:[a-z]+:)?/*(.*)$", 1)
    start = root.split(":", 1)[-1].strip("/")
    inside = F.substr(below, F.lit(len(start) + 2))
    named = [F.when(F.startswith(inside, F.lit(prefix)), F.lit(source)) for prefix, source in sources.items()]
    return files.select(F.coalesce(*named).alias("source"), "path", F.col("length").alias("bytes")).where("source is not null")


def message_trees(spark: SparkSession, path: str) -> DataFrame:
    """A row for each message of trees in JSON lines, whatever their depth: MESSAGE's columns. Bad lines have an id of null and their text."""

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in MESSAGE.split(", ")]
        for frame in batches:
            rows = []
            for line in frame["value"]:
                if not line.strip():
                    continue
                try:
                    tree = json.loads(line)
                    todo = [(tree["prompt"], None, 0)]
                except (ValueError, KeyError, TypeError):
                    rows.append([None] * 6 + [line] + [None] * 6)
                    continue
                while todo:
                    m, parent, place = todo.pop()
                    spam = ((m.get("labels") or {}).get("spam") or {}).get("value")
                    rows.append([
                        tree.get("message_tree_id"), m.get("message_id"), parent, place, "user" if m.get("role") == "prompter" else "assistant", m.get("lang"), m.get("text"), m.get("rank"),
                        bool(m.get("deleted")), bool(m.get("synthetic") or m.get("model_name")), m.get("review_result"), spam, tree.get("tree_state"),
                    ])
                    todo += [(r, m.get("message_id"), i) for i, r in enumerate(m.get("replies") or [])]
            yield pd.DataFrame(rows, columns=columns).astype({"place": "Int32", "rank": "Int32"})

    return spark.read.text(path).mapInPandas(flat, MESSAGE)


def usable(messages: DataFrame) -> DataFrame:
    """The messages with `problem`, the first reason against each, or null."""
    marked = grams.model_phrase(F.col("text"))
    return messages.withColumn("problem", cleaning.message_problem(F.col("deleted"), F.col("synthetic"), F.col("review"), F.col("spam"), F.col("lang"), F.col("text"), marked))


def instruction_rows(rows: DataFrame, key: str = "id") -> DataFrame:
    """(id, reason, turns, text, split_key) of instruction, context and response; rows that share a context share a split key."""
    part = lambda c: F.trim(F.coalesce(c, F.lit("")))
    ask, context, answer = part("instruction"), part("context"), part("response")
    user = cleaning.normalized(F.concat(ask, F.when(context != "", F.concat(F.lit("\n\n"), context)).otherwise("")))
    held = rows.select(F.col(key).alias("id"), user.alias("user"), cleaning.normalized(answer).alias("answer"), cleaning.normalized(context).alias("context"), ((ask == "") | (answer == "")).alias("blank"))
    held = held.withColumn("text", F.concat_ws("\n", "user", "answer"))
    reason = F.when(F.col("blank"), "empty").otherwise(F.coalesce(text.hygiene_reason(F.col("text")), F.when(grams.model_phrase(F.col("text")), "aiism")))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("text"))
    split = F.when(F.col("context") != "", F.concat(F.lit("ctx:"), F.sha1(F.col("context").cast("binary")))).otherwise(F.concat(F.lit("row:"), F.col("id").cast("string")))
    return held.select("id", reason.alias("reason"), F.array(turn("user", "user"), turn("assistant", "answer")).alias("turns"), "text", split.alias("split_key"))


def posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of an XML dump, an element `row` each, with attributes as columns of strings."""
    names = ("Id", "PostTypeId", "ParentId", "CreationDate", "LastEditDate", "Score", "Body", "Title", "AcceptedAnswerId", "OwnerUserId", "ContentLicense", "ClosedDate")
    raw = spark.read.format("xml").option("rowTag", "row").option("attributePrefix", "").schema(", ".join(f"{n} string" for n in names)).load(path)
    return raw.where(F.col("Id").isNotNull())


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def write_counts(counts: DataFrame, path: str, about: dict[str, str]) -> None:
    """A table of counts as parquet, and beside it one JSON line that says what was counted."""
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    spark = counts.sparkSession
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_counts(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    return spark.read.parquet(f"{path}/counts"), json.loads(spark.read.text(f"{path}/about").head()[0])


def write_token_shards(rows: DataFrame, path: str, shards: int, key: Column, order: str) -> None:
    """Rows by shard: key modulo their number, ordered by (key, order) inside, a file for each shard."""
    placed = rows.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int")).withColumn("sort_key", key)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "sort_key", order).drop("sort_key").write.mode("overwrite").partitionBy("shard").parquet(path)


def publish(spark: SparkSession, written: str, final: str) -> bool:
    """Moves a complete folder to its name in one step; False if the name is taken, so a reader sees all of it or nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(written), hadoop.Path(final)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop.Path(f"{written}/_SUCCESS")):
        raise FileNotFoundError(f"{written} is not complete")
    if files.exists(target):
        return False
    files.mkdirs(target.getParent())
    return bool(files.rename(source, target))


def merged_counters(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(name, value): counters of many workers as one, the largest where the name begins with max_, else the sum."""
    return rows.groupBy(name).agg(F.when(F.startswith(F.col(name), F.lit("max_")), F.max(value)).otherwise(F.sum(value)).alias(value))


def verified_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(path, state) of a manifest's files (path below the root, bytes, sha256): ok, missing, size or hash; files that it doesn't name are unknown."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    start = len(root.split(":", 1)[-1].strip("/"))
    below = F.substr(F.regexp_replace("path", r"^(?:[a-z]+:)?/*", ""), F.lit(start + 2))
    found = files.select(below.alias("path"), F.col("length").alias("has_bytes"), F.sha2("content", 256).alias("has_hash"))
    both = manifest.select("path", "bytes", "sha256", F.lit(True).alias("named")).join(found, "path", "full")
    state = F.when(F.col("named").isNull(), "unknown").when(F.col("has_bytes").isNull(), "missing").when(F.col("bytes") != F.col("has_bytes"), "size").when(F.col("sha256") != F.col("has_hash"), "hash").otherwise("ok")
    return both.select("path", state.alias("state"))


#: Readers by name: a plan may name one, and others may be added.
READERS = {"trees": message_trees, "posts": posts}
