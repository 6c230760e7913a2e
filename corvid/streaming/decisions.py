"""The event log as streams: decisions per window and the latest feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def decision_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type; an id counts once within the watermark."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def upsert_latest(target: str):
    """A foreachBatch function that appends each batch's latest feedback per key to ``target`` as Parquet.

    A batch that is run again overwrites its own folder, so a restart changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from corvid.operators.eventlog import latest_feedback

        latest_feedback(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write
