"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (tests, local mode)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder so that lost executors cost nothing already done.

    Writing a table cuts the lineage as a checkpoint does and keeps columns compressed. Tables that a
    later one replaces are dropped at once; what a returned DataFrame still reads is dropped when the
    session ends.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        """With a ``path`` the tables are kept in that folder, also when the session ends."""
        small_batches(spark)
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex[:12]}"
        if not path:
            atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        to = f"{self.path}/{name}-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._tessera_path = to
        return out

    def tables(self, name: str, schema: str) -> list[DataFrame]:
        """The tables saved under a name, oldest first, but for those whose writing was cut short."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}-*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        out = []
        for to in sorted(x.getPath().getParent().toString() for x in found):
            out.append(self.spark.read.schema(schema).parquet(to))
            out[-1]._tessera_path = to
        return out

    def drop(self, *frames: DataFrame) -> None:
        for x in frames:
            delete(self.spark, x._tessera_path)

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                delete(self.spark, self.path)
        except Exception:  # the session has ended: nothing can be reached any more
            return


def merged(df: DataFrame) -> DataFrame:
    """Joined by sorting, whatever its size, so that small inputs run the plan of large ones and nothing unbounded is broadcast."""
    return df.hint("merge")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that rows of long texts do not meet by the ten thousand in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
