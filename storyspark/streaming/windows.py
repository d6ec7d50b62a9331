"""Windowed streams: velocity, yield starvation and re-fetched bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed
from storyspark.sources.fetches import body_hash

LATE_BY = "1 hour"


def event_velocity(event_docs: DataFrame, late_by: str = LATE_BY) -> DataFrame:
    """Documents of each event in every 30-minute window, sliding by a minute.

    Documents are counted per minute first, so only one row per event and minute is copied into the thirty
    windows that contain it.
    """
    minutes = (
        event_docs.withWatermark("seen_at", late_by)
        .groupBy(F.window("seen_at", "1 minute"), "event_id")
        .agg(F.count("*").alias("n"))
        .select("event_id", "n", F.window_time("window").alias("minute"))
    )
    return (
        minutes.groupBy(F.window("minute", f"{fixed.VELOCITY_WINDOW_MINUTES} minutes", "1 minute"), "event_id")
        .agg(F.sum("n").alias("velocity"))
        .select("event_id", "window.start", "window.end", "velocity")
    )


def yield_starvation(attempts: DataFrame, window_hours: int = 24, late_by: str = LATE_BY) -> DataFrame:
    """Closed windows in which every fetch of a source succeeded and brought nothing."""
    return (
        attempts.withWatermark("attempted_at", late_by)
        .groupBy(F.window("attempted_at", f"{window_hours} hours"), "source_id")
        .agg(
            F.count("*").alias("attempts"),
            F.bool_and(F.col("status_code") == 200).alias("all_ok"),
            F.sum("yield_count").alias("total_yield"),
        )
        .filter("all_ok AND total_yield = 0")
        .select("source_id", F.col("window.start").alias("window_start"), "attempts")
    )


def first_fetches(fetched: DataFrame, late_by: str = "1 day") -> DataFrame:
    """Fetches whose body was not seen within the watermark; ``fetched`` has ``body`` and ``fetched_at``."""
    hashed = fetched.withColumn("snapshot_hash", body_hash(F.col("body"))).drop("body")
    return hashed.withWatermark("fetched_at", late_by).dropDuplicatesWithinWatermark(["snapshot_hash"])
