"""The change feed as batch and stream, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import paths

SCHEMA = "seq bigint, ts timestamp, op string, file_id bigint, path string, new_path string, version bigint, author string, batch string"


def since(changes: DataFrame, seq: int = 0, limit: int = 10_000) -> DataFrame:
    """Changes after seq, oldest first."""
    return changes.where(F.col("seq") > seq).orderBy("seq").limit(limit)


def last_seq(changes: DataFrame) -> DataFrame:
    return changes.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"))


def stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The feed as a stream of append-only Parquet files."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def watch(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Calls handle with each batch's changes in order and the batch's number.

    A batch that was not finished when the query stopped comes again with the same number and the same changes, so a handler that
    writes elsewhere should keep the last number. No change is dropped for coming late.
    """
    writer = changes.writeStream.foreachBatch(lambda df, n: handle(df.dropDuplicates(["seq"]).orderBy("seq"), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def folder_activity(changes: DataFrame) -> DataFrame:
    """Running (folder, changes) of all folders; for update or complete mode."""
    return changes.select(F.explode(paths.ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("changes"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value) by window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n) of each user's runs of events without a longer gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")
