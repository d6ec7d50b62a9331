"""Source health: yield starvation, yield baselines and latency targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed

BASELINE_DAYS = 28
_DAY = 86_400


def yield_starvation(attempts: DataFrame, window_hours: int | Column = 24) -> DataFrame:
    """Windows in which every fetch of a source succeeded and brought nothing.

    ``attempts``: ``source_id, attempted_at, status_code, yield_count``. ``window_hours`` may be a column, so
    that every source keeps the window of its profile.
    """
    hours = window_hours if isinstance(window_hours, Column) else F.lit(window_hours)
    span = hours.cast("bigint") * 3600
    start = F.floor(F.unix_timestamp("attempted_at") / span).cast("bigint") * span
    return (
        attempts.groupBy("source_id", F.timestamp_seconds(start).alias("window_start"))
        .agg(
            F.count("*").alias("attempts"),
            F.bool_and(F.col("status_code") == 200).alias("all_ok"),
            F.sum("yield_count").alias("total_yield"),
        )
        .filter("all_ok AND total_yield = 0")
        .select("source_id", "window_start", "attempts")
    )


def yield_baseline(attempts: DataFrame) -> DataFrame:
    """Mean yield per source and hour, next to its mean at the same weekday and hour of the last four weeks.

    Attempts are summed per hour before any window, so a busy source has one row per hour.
    """
    hour = F.date_trunc("hour", "attempted_at")
    slots = attempts.groupBy("source_id", hour.alias("slot")).agg(
        F.count("*").alias("attempts"), F.sum("yield_count").alias("total_yield")
    )
    same_slot = (
        W.partitionBy("source_id", F.dayofweek("slot"), F.hour("slot"))
        .orderBy(F.unix_timestamp("slot"))
        .rangeBetween(-BASELINE_DAYS * _DAY, -1)
    )
    return slots.select(
        "source_id",
        "slot",
        "attempts",
        (F.col("total_yield") / F.col("attempts")).alias("mean_yield"),
        (F.sum("total_yield").over(same_slot) / F.sum("attempts").over(same_slot)).alias("baseline_yield"),
    )


def latency_p95(attempts: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Exact latency percentile per pool and whether it misses the pool's target.

    Latencies are whole milliseconds, so counting them per value first leaves few rows per pool.
    """
    counts = attempts.groupBy("pool", "latency_ms").agg(F.count("*").alias("n"))
    upto = W.partitionBy("pool").orderBy("latency_ms").rowsBetween(W.unboundedPreceding, 0)
    running = counts.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "total", F.sum("n").over(W.partitionBy("pool"))
    )
    reached = F.col("upto") >= F.ceil(F.col("total") * quantile - 1e-9)
    target_s = (
        F.when(F.col("pool") == "FAST_POOL", F.lit(fixed.FAST_TIMEOUT_S))
        .when(F.col("pool") == "HEAVY_RENDER_POOL", F.lit(fixed.RENDER_TIMEOUT_S))
        .otherwise(F.lit(fixed.DEEP_TARGET_S))
    )
    return (
        running.groupBy("pool")
        .agg(F.max("total").alias("attempts"), F.min(F.when(reached, F.col("latency_ms"))).alias("p95_ms"))
        .select("pool", "attempts", "p95_ms", (F.col("p95_ms") > target_s * 1000).alias("is_breach"))
    )


def error_counts(attempts: DataFrame) -> DataFrame:
    """Fetches and failures per source and pool."""
    return attempts.groupBy("source_id", "pool").agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("status_code").between(400, 499)).alias("client_errors"),
        F.count_if(F.col("status_code") >= 500).alias("server_errors"),
    )
