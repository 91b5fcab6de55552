"""Lineage cuts: tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch: a worker's memory follows them, not the lengths of texts.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset: a temporary folder if Spark runs in this process alone (tests, local
    runs), else an error, as other machines could not read it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def in_batches(df: DataFrame, run: Callable, kind: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, kind)`` with batches of ``BATCH_BYTES`` about. Spark bounds them by rows alone unless told otherwise; where the session
    has no ``spark.sql.execution.arrow.maxBytesPerBatch``, it is set."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, kind)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs neither repeat its work nor lose it with an executor."""
    return _written(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


class Rounds:
    """A table that every round replaces: once a round is written, the one before it is deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.round = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.round += 1
        out = _written(df, f"{self.base}/{self.round}")
        self._drop(self.round - 1)
        return out

    def _drop(self, k: int) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{k}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
