"""Checkpoints and logs for iterative operators, in the folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset: a temporary folder if Spark runs in this process alone, else an error, as other machines could not read it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def deleted(spark: SparkSession, path: str) -> None:
    """A folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def released(*done: DataFrame) -> None:
    """Delete the files of checkpointed tables that nothing reads any more, and have Spark delete those of shuffles that nothing refers to: it does so only when
    the driver collects garbage, which a driver that holds little does too seldom for a loop whose steps each leave some."""
    for df in done:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            deleted(df.sparkSession, file.get())
    if done:
        done[0].sparkSession.sparkContext._jvm.System.gc()


class Log:
    """Rows by their ``step`` in the shared folder: added as steps make them, read by the step they are for. ``by``: another column that rows are kept by, and those they are dealt by."""

    def __init__(self, spark: SparkSession, name: str, schema: str, by: tuple[str, ...] = ("step", "j")):
        self.spark, self.schema, self.path, self.used, self.by = spark, schema, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", False, by

    def add(self, rows: DataFrame) -> None:
        rows.repartition(*self.by).write.mode("append").partitionBy(self.by[0]).parquet(self.path)
        self.used = True

    def every(self) -> DataFrame:
        names = [c.split()[0] for c in self.schema.split(", ")]
        if not self.used:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*names)

    def of(self, step: int) -> DataFrame:
        return self.every().where(f"step = {step}")

    def among(self, keys: list[int]) -> DataFrame:
        """Rows of some keys of ``by``: other files are not read."""
        return self.every().where(F.col(self.by[0]).isin(keys))

    def drop_step(self, step: int) -> None:
        """Delete one step's rows, once they are not to be read any more."""
        deleted(self.spark, f"{self.path}/{self.by[0]}={step}")

    def drop(self) -> None:
        """Delete it, once nothing is to be read any more."""
        deleted(self.spark, self.path)
