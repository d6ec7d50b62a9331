"""Event state rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed
from storyspark.functions.scores import elapsed_seconds


def hydration_timeout_s(pool: Column) -> Column:
    return F.when(pool == "FAST_POOL", F.lit(fixed.FAST_TIMEOUT_S)).otherwise(F.lit(fixed.RENDER_TIMEOUT_S))


def next_status(status: Column, pool: Column, hydration_start_at: Column, as_of: Column) -> Column:
    """One step: NEW starts hydrating, an overdue hydration becomes partial, all else stays."""
    overdue = elapsed_seconds(hydration_start_at, as_of) > hydration_timeout_s(pool)
    return (
        F.when(status == "NEW", F.lit("HYDRATING"))
        .when((status == "HYDRATING") & overdue, F.lit("PARTIAL_ENRICH"))
        .otherwise(status)
    )


def expire_quarantine(
    status: Column, quarantined_at: Column, as_of: Column, ttl_s: int = fixed.QUARANTINE_TTL_S
) -> Column:
    overdue = elapsed_seconds(quarantined_at, as_of) > ttl_s
    return F.when((status == "QUARANTINE") & overdue, F.lit("EXPIRED")).otherwise(status)


def is_quarantine_case(breaking: Column, source_count: Column) -> Column:
    """Low score although several sources report it."""
    return (breaking < fixed.QUARANTINE_SCORE_BELOW) & (source_count >= fixed.QUARANTINE_MIN_SOURCES)


def is_unverified_viral(velocity: Column, diversity: Column) -> Column:
    return (velocity > fixed.VIRAL_VELOCITY_ABOVE) & (diversity >= fixed.VIRAL_MIN_DIVERSITY)
