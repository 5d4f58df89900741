"""Event-time windows, for streams and tables alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("string").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("string").alias("start"), "n")


def stream_counts(spark: SparkSession, path: str, checkpoint: str, out: str, width: str = "1 day") -> DataFrame:
    """All files of a folder as a stream: counts per window with a watermark, appended
    to Parquet with exactly-once files; returns what was written."""
    schema = spark.read.parquet(path.rstrip("*")).schema
    events = spark.readStream.schema(schema).parquet(path)
    counts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    query = counts.select(F.col("w.start").alias("start"), "event_type", "n").writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{checkpoint}/{uuid.uuid4().hex}").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema("start timestamp, event_type string, n long").parquet(out)


STATE = "n long, last_seen timestamp"


def _count_users(key, frames, state):
    """One user's events so far and the last time, kept between batches."""
    import pandas as pd

    n, last = state.get if state.exists else (0, None)
    for f in frames:
        n += len(f)
        top = f["ts"].max()
        last = top if last is None or top > last else last
    state.update((n, last))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_seen": [last]})


def stream_users(spark: SparkSession, path: str, checkpoint: str, out: str, files_a_batch: int = 1) -> DataFrame:
    """Events of a folder as a stream with state for each user; every batch writes what
    changed, and the newest row of a user counts. A batch that is run again after a
    failure replaces its own files."""
    schema = spark.read.parquet(path.rstrip("*")).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    kept = events.groupBy("user_id").applyInPandasWithState(_count_users, "user_id long, n long, last_seen timestamp", STATE, "update", "NoTimeout")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy("user_id").agg(F.max_by("n", "batch").alias("n"), F.max_by("last_seen", "batch").alias("last_seen"))
