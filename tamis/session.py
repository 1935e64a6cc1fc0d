"""Session factory and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tamis", cores: str | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session to every operator instead.

    On a cluster the executors' Python needs this package, as vectorised functions are sent by reference: submit with
    `--py-files` of the zipped package, or call `ship_package`.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors of a running session."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tamis", "zip", root, "tamis"))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a local session gets a new temporary one; a cluster, whose
    executors wouldn't see that, is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tamis-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, to cut lineage and to be read more than once.

    Files survive lost executors. A table that is no longer needed can be dropped by name; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.calls = spark, 0
        self.root = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
        target = self._path(self.root)
        self._files(target).deleteOnExit(target)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, target):
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def fresh(self, name: str) -> str:
        """The name with a number that no other call got."""
        self.calls += 1
        return f"{name}-{self.calls}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes the named tables, or all of them."""
        for path in map(self.path, names) if names else (self.root,):
            target = self._path(path)
            self._files(target).delete(target, True)
