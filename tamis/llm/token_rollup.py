"""Token totals that follow a corpus by signed deltas.

A batch of changes is summed to one signed row for each source, language and tokenizer version before it is shuffled, and
written as a folder of its own. A batch counts once its folder is complete, and a batch that is complete is never written again, so a
retry or a replay changes nothing, and a half-written batch is written anew. Totals are the sums over complete batches; a
snapshot holds the sums of some batches and the list of them, so that they needn't be read again, and a batch of a lower number that comes
after it counts all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs long, tokens long"
#: Tokenizer versions that the SQL check can repeat; any other column that counts a text's tokens may be given instead.
VERSIONS = {"words-1": r"[^ \t\n\x0B\f\r]+", "words-2": r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x00-\x20]"}


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def by_version(counts: DataFrame, columns: dict[str, dict[str, str]], extra: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document and tokenizer version. columns: version -> name in the result -> name in `counts`. Null counts stay
    null and add nothing; repeated rows count each; an empty table gives no rows."""
    each = F.array(*(F.struct(F.lit(v).alias("version"), *(F.col(c).cast("long").alias(n) for n, c in names.items())) for v, names in columns.items()))
    return counts.select("source", "lang", *extra, F.explode(each).alias("x")).select("source", "lang", *extra, "x.*")


def inserted(rows: DataFrame) -> DataFrame:
    """Changes for documents with `tokens` that arrive; each row is a document, repeated ones too, and null tokens add a document only."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deleted(rows: DataFrame) -> DataFrame:
    """Changes for documents with `tokens` that go; nulls and repeats as in `inserted`."""
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(rows: DataFrame) -> DataFrame:
    """Changes for documents whose count becomes `tokens` and was `was`; where either is null nothing is added."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.col("tokens") - F.col("was")).alias("tokens"))


class TokenRollup:
    """Totals in a folder that all executors share. Null sources and languages are groups of their own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Adds a batch of signed changes; False if the batch was there already, whatever `changes` holds. Fits foreachBatch."""
        path = f"{self.folder}/batch={int(batch)}"
        if self._exists(f"{path}/_SUCCESS"):
            return False
        summed = changes.groupBy(*KEYS).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        summed.where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(path)
        return True

    def _complete(self, kind: str) -> dict[int, str]:
        """Complete folders of a kind (batch or snapshot) by number."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        found = hadoop.Path(f"{self.folder}/{kind}=*/_SUCCESS")
        listed = found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
        paths = [x.getPath().getParent().toString() for x in listed or ()]
        return {int(p.rsplit("=", 1)[1]): p for p in paths}

    def _every(self) -> tuple[set[int], set[int], DataFrame]:
        """All complete batches, those that the last snapshot holds, and the rows that sum to the totals."""
        batches, snapshots, covers = self._complete("batch"), self._complete("snapshot"), self._complete("covers")
        last = max((n for n in snapshots if n in covers), default=None)
        held = set() if last is None else {r["batch"] for r in self.spark.read.schema("batch int").parquet(covers[last]).collect()}
        paths = [] if last is None else [snapshots[last]]
        paths += [p for n, p in sorted(batches.items()) if n not in held]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return set(batches) | held, held, rows

    def compact(self) -> int:
        """Writes a snapshot of all complete batches; how many it holds. One that is there already is not written again, and one that was half-written doesn't
        count, as its list of batches is written last."""
        every, held, rows = self._every()
        if every - held:
            number = max([*self._complete("snapshot"), 0]) + 1
            summed = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            summed.write.mode("overwrite").parquet(f"{self.folder}/snapshot={number}")
            self.spark.createDataFrame([(n,) for n in sorted(every)], "batch int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/covers={number}")
        return len(every)

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens over all complete batches; groups whose documents all went are left out."""
        every = self._every()[2]
        return every.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0")


def measured(docs: DataFrame, versions: dict[str, Column], text: str = "text") -> DataFrame:
    """source, lang, a byte estimate and each version's count of every document; null and empty texts count 0."""
    estimate = F.floor(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("long")
    return docs.select("source", "lang", estimate.alias("estimate"), *(c.alias(f"n_{i}") for i, c in enumerate(versions.values())))
