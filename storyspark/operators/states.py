"""State steps of all events at one point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions import states as S


def state_transitions(events: DataFrame, as_of: Column) -> DataFrame:
    """Events whose state changes now, as history rows ``event_id, old_status, status, status_reason, updated_at``.

    ``events``: ``event_id, status, pool, started_at``, where ``started_at`` is when the state began.
    """
    stepped = S.next_status(F.col("status"), F.col("pool"), F.col("started_at"), as_of)
    expired = S.expire_quarantine(F.col("status"), F.col("started_at"), as_of)
    status = F.when(F.col("status") == "QUARANTINE", expired).otherwise(stepped)
    reason = (
        F.when(F.col("status") == "HYDRATING", F.lit("hydration timeout"))
        .when(F.col("status") == "QUARANTINE", F.lit("quarantine expired"))
        .otherwise(F.lit("hydration started"))
    )
    return (
        events.withColumn("_next", status)
        .filter("_next <> status")
        .select(
            "event_id",
            F.col("status").alias("old_status"),
            F.col("_next").alias("status"),
            reason.alias("status_reason"),
            as_of.alias("updated_at"),
        )
    )


def deadline(status: Column, pool: Column, at: Column) -> Column:
    """When a state times out; null for states without a limit."""
    limit = F.when(status == "HYDRATING", S.hydration_timeout_s(pool)).when(status == "QUARANTINE", F.lit(S.fixed.QUARANTINE_TTL_S))
    return F.timestamp_micros(F.unix_micros(at) + limit.cast("bigint") * 1_000_000)


def timed_transitions(states: DataFrame, as_of: Column) -> DataFrame:
    """Every timeout in a state log: ``event_id, old_status, status, at``.

    ``states``: ``event_id, status, pool, at, next_at``. A state times out when it lasts longer than its
    limit before the next state, or before ``as_of`` when it is the last one. What the log says of times after ``as_of``
    does not exist yet: such states are not judged, and one that follows then ends no earlier one.
    """
    target = F.when(F.col("status") == "HYDRATING", F.lit("PARTIAL_ENRICH")).otherwise(F.lit("EXPIRED"))
    return (
        states.filter(F.col("at") <= as_of)
        .withColumn("_deadline", deadline(F.col("status"), F.col("pool"), F.col("at")))
        .filter(F.col("_deadline") < F.least(F.col("next_at"), as_of))
        .select("event_id", F.col("status").alias("old_status"), target.alias("status"), F.col("_deadline").alias("at"))
    )
