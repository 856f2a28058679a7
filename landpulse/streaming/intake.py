"""Continuous intake: new notification files are read as they arrive and treated like the batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from landpulse import schemas
from landpulse.operators.timeline import STAGES, normalise_notifications


def notification_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Notification CSV files of a folder as a stream, normalised by the batch rules."""
    raw = (
        spark.readStream.schema(schemas.NOTIFICATIONS)
        .option("header", "true").option("escape", '"').option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    return normalise_notifications(raw)


def stage_counts(notifications: DataFrame) -> DataFrame:
    """Events per stage so far; one state row per stage code."""
    known = F.when(F.col("notification_type").isin(*STAGES), F.col("notification_type")).otherwise("UNKNOWN")
    return notifications.groupBy(known.alias("stage")).agg(F.count(F.lit(1)).alias("events"))
