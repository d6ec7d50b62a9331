"""Latency percentiles of a stream as mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed

#: Size of a sketch: the rank of a quantile is right to about one in 150 with high probability.
SKETCH_K = 400
RANK_ERROR = 0.0133


def latency_sketches(attempts: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """``pool, window_start, attempts, sketch`` per window of a stream of ``pool, attempted_at, latency_ms``: a few kilobytes, whatever the number of fetches."""
    return (
        attempts.withWatermark("attempted_at", watermark)
        .groupBy(F.window("attempted_at", window), "pool")
        .agg(F.count("latency_ms").alias("attempts"), F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint"), F.lit(SKETCH_K)).alias("sketch"))
        .select("pool", F.col("window.start").alias("window_start"), "attempts", "sketch")
    )


def slo_of_sketches(sketches: DataFrame, quantile: float = 0.95) -> DataFrame:
    """``pool, attempts, p95_ms, is_breach`` over the stored sketches of any windows, merged; they may come from many days and streams."""
    merged = sketches.groupBy("pool").agg(F.sum("attempts").alias("attempts"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    reached = merged.select("pool", "attempts", F.kll_sketch_get_quantile_bigint("sketch", F.lit(quantile)).alias("p95_ms"))
    return reached.withColumn("is_breach", F.col("p95_ms") > target_ms(F.col("pool")))


def target_ms(pool: Column) -> Column:
    target_s = F.when(pool == "FAST_POOL", F.lit(fixed.FAST_TIMEOUT_S)).when(pool == "HEAVY_RENDER_POOL", F.lit(fixed.RENDER_TIMEOUT_S)).otherwise(F.lit(fixed.DEEP_TARGET_S))
    return target_s * 1000
