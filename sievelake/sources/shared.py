"""Tables in the folder that all executors share, where iterative operators cut their lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode where the session names no shared folder (tests, local runs).
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints/sievelake"


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a cluster a session without it is an error, as a local folder is each machine's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_CHECKPOINT_DIR


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is scratch
        pass


#: Paths of tables that are not dropped yet.
_HELD: dict[str, SparkSession] = {}


def free_scratch() -> int:
    """Deletes the scratch tables made so far; returns how many. For long sessions, once results are written: plans that still
    read them fail afterwards."""
    paths = list(_HELD.items())
    for path, spark in paths:
        delete(spark, path)
        _HELD.pop(path, None)
    return len(paths)


atexit.register(free_scratch)


class Stored:
    """A DataFrame written once to the shared folder; ``df`` starts from its files, so a lost executor costs a re-read.

    Files go when drop() or free_scratch() is called or the process ends.
    """

    def __init__(self, df: DataFrame, label: str, partition_by: tuple[str, ...] = ()):
        self.spark = df.sparkSession
        self.path = f"{checkpoint_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _HELD[self.path] = self.spark

    def drop(self) -> None:
        """Removes the files; only where no unfinished plan reads them."""
        delete(self.spark, self.path)
        _HELD.pop(self.path, None)
