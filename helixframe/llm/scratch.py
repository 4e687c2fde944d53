"""Tables written between the jobs of one operator.

They cut lineage, so a lost executor costs a re-read and not a recomputation,
and live below ``spark.checkpoint.dir``, which driver and executors share.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from .worker import bound_batches


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where it is unset, one of our own on a single machine and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """A folder of Parquet tables for one call of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.path = f"{shared_dir(spark)}/helixframe/{name}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write ``df`` and read it back under its own schema."""
        df.write.mode("overwrite").parquet(self.at(name), compression=compression)
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, on whatever file system."""
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished jobs whose DataFrames are gone."""
        for _ in range(2):  # what the first round frees may hold what the second one does
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
