"""Folders of Parquet files read as streams."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import attach
from .windows import stream_counts, stream_users


def work_folder(spark: SparkSession) -> str:
    """Below spark.checkpoint.dir, which all executors share; a temporary one only for a
    session of one machine where that is unset (tests). A cluster without it is refused."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="foliolake-stream-")
    path = f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            return

    atexit.register(drop)
    return path


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, counted by a stream over the folder's event files and
    appended once the watermark has passed a day."""
    path = work_folder(spark)
    return stream_counts(attach(spark), f"{sf_dir}/events.parquet*", f"{path}/state", f"{path}/out").withColumn("start", F.col("start").cast("string"))


def user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user and the last time, by a stream with state."""
    path = work_folder(spark)
    got = stream_users(attach(spark), f"{sf_dir}/events.parquet*", f"{path}/state", f"{path}/out")
    return got.select("user_id", "n", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def handle_archives(spark: SparkSession, folder: str, out: str, state: str, depth: int = 3) -> DataFrame:
    """Archives that come into a folder, each handled once: their members' lines, written by
    batch; a batch that is run again replaces its own files."""
    from ..sources import readers

    spark = attach(spark)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", 16).load(folder)

    def handle(batch: DataFrame, number: int) -> None:
        found = readers.read_attachments(batch.select("path", "content"), depth).where("error IS NULL")
        readers.read_items(found.select("path", "content")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    files.writeStream.foreachBatch(handle).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
