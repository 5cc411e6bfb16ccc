"""Tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# While a table is written: a step's shuffle files go as soon as it is complete, not when the driver
# happens to collect garbage; and batches for Python are small, as rows with whole texts or sets are wide.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where that is unset and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or f"file://{tempfile.mkdtemp(prefix='foliospark-')}"


def small_batches(spark: SparkSession) -> None:
    """For plans that run after their operator has returned: the session's Arrow batches are bounded by bytes, unless it
    has a bound of its own. Rows hold whole texts, so a bound by rows is none."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, WHILE_WRITING[name])


class Scratch:
    """Parquet tables of one run; each is complete before anything reads it."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        self.path_of: dict[int, tuple[DataFrame, str]] = {}

    def path(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def put(self, df: DataFrame) -> DataFrame:
        path = self.path()
        before = {k: self.spark.conf.get(k) for k in WHILE_WRITING}
        try:
            for k, v in WHILE_WRITING.items():
                self.spark.conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.path_of[id(out)] = out, path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        self._delete(self.path_of.pop(id(df))[1])

    def keep(self, *frames: DataFrame) -> None:
        """Delete all tables but these."""
        kept = {id(x) for x in frames}
        for key in [k for k in self.path_of if k not in kept]:
            self._delete(self.path_of.pop(key)[1])

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
