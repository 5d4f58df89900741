"""Intermediate tables in storage that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the one set as checkpoint folder. With
    neither, one machine's session (tests) gets a temporary one; a cluster's is refused,
    since its executors share no local folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliolake-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def keep(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it again: later steps depend on
    files, not on executors."""
    spark = df.sparkSession
    return keep_at(df, new_path(spark, what), **options)


def keep_at(df: DataFrame, path: str, **options: str) -> DataFrame:
    """The same at a path that the caller drops when no later step reads it."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer
    referenced; to call after their results were written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # the session has ended already
            return
