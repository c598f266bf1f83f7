"""Intermediate tables in the folder that driver and executors share.

A step that is read more than once, or that cuts the lineage of an iteration, is
written as Parquet below ``spark.checkpoint.dir`` and read back, so that a lost
executor costs a re-read and never a recomputation of the whole history.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_root: list[str] = []

#: Shuffle files go when the query that wrote them ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder its context checkpoints to; a
    local folder only if both are unset and all work is in this process."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="millrace-"))
    return f"file://{_local_root[0]}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """A folder of its own for the tables of one operator call.

    Tables live until ``drop`` or the end of the driver's Python process, as the
    lazy result of an operator may still read them. With ``tidy`` the shuffle files of a
    table are deleted once it is written.
    """

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        self.spark = spark
        self.tidy = tidy
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._clean)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))

    def _clean(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the JVM may be gone at exit
            pass


def join_small(df: DataFrame, small: DataFrame, on: list[str], max_rows: int, how: str = "left") -> DataFrame:
    """Join with a stored table: broadcast if its counted rows are at most
    ``max_rows``, else an ordinary join that AQE may split on skewed keys."""
    return df.join(F.broadcast(small) if small.count() <= max_rows else small, on, how)
