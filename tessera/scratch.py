"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, on one machine only, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jsc.isDefined():
        return jsc.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
    own = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables of one computation below one new folder. What is read from them ends where they are dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read again: lineage ends here."""
        self.count += 1
        path = f"{self.folder}/{self.count}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        delete(self.spark, self.folder)


def fits(df: DataFrame, row_bytes: int, limit: int = 16 << 20) -> bool:
    """Whether ``df``, counted, stays below ``limit`` bytes; only then may it be broadcast."""
    return df.limit(limit // row_bytes + 1).count() <= limit // row_bytes
