"""Scores of all events in one grouped job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed
from storyspark.functions import scores as S


def velocity_since(as_of: Column, minutes: int = fixed.VELOCITY_WINDOW_MINUTES) -> Column:
    return as_of - F.expr(f"INTERVAL {minutes} MINUTES")


def event_velocity(event_docs: DataFrame, as_of: Column) -> DataFrame:
    """Documents of each event in the last 30 minutes."""
    recent = F.col("seen_at") >= velocity_since(as_of)
    return event_docs.groupBy("event_id").agg(F.count_if(recent).alias("velocity"))


def event_source_stats(event_docs: DataFrame, sources: DataFrame, distinct_sources: bool = False) -> DataFrame:
    """Tier, official flag and number of reports per event.

    The count is of documents with a known source; ``distinct_sources=True`` counts sources instead.
    Reports are first summed per event and source, so a busy source or event shuffles few rows.
    """
    reports = event_docs.groupBy("event_id", "source_id").agg(F.count("*").alias("n"))
    known = reports.join(sources.select("source_id", "tier", "is_official"), "source_id")
    total = F.count("*") if distinct_sources else F.sum("n")
    return known.groupBy("event_id").agg(
        total.alias("source_count"),
        F.min("tier").alias("highest_tier"),
        F.bool_or("is_official").alias("has_official"),
        F.bool_or(F.col("tier") == 1).alias("has_tier1"),
    )


def event_metrics(event_docs: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Everything the scores need, in one aggregation with a single shuffle by event.

    ``event_docs`` carries the ``evidence_score`` of its documents.
    """
    reports = event_docs.select("event_id", "source_id", "seen_at", "evidence_score")
    known = sources.select("source_id", "tier", "is_official")
    return reports.join(known, "source_id", "left").groupBy("event_id").agg(
        F.count("tier").alias("source_count"),
        F.coalesce(F.min("tier"), F.lit(3)).alias("highest_tier"),
        F.coalesce(F.bool_or("is_official"), F.lit(False)).alias("has_official"),
        F.coalesce(F.bool_or(F.col("tier") == 1), F.lit(False)).alias("has_tier1"),
        F.count_if(F.col("seen_at") >= velocity_since(as_of)).alias("velocity"),
        F.coalesce(F.max("evidence_score"), F.lit(0.0)).alias("max_evidence"),
    )


def score_events(events: DataFrame, event_docs: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Both scores with reasons for every known event; an event without documents gets the defaults."""
    metrics = event_metrics(event_docs, sources, as_of)
    zero = F.lit(0).cast("bigint")
    known = events.select("event_id", "first_seen_at").join(metrics, "event_id", "left")
    rows = known.select(
        "event_id",
        "first_seen_at",
        F.coalesce("source_count", zero).alias("source_count"),
        F.coalesce("highest_tier", F.lit(3)).alias("highest_tier"),
        F.coalesce("has_official", F.lit(False)).alias("has_official"),
        F.coalesce("has_tier1", F.lit(False)).alias("has_tier1"),
        F.coalesce("velocity", zero).alias("velocity"),
        F.coalesce("max_evidence", F.lit(0.0)).alias("max_evidence"),
        as_of.alias("computed_at"),
    )
    breaking = (
        F.col("highest_tier"),
        F.col("velocity"),
        F.col("source_count"),
        F.col("first_seen_at"),
        F.col("computed_at"),
    )
    gap = F.col("max_evidence"), F.col("has_tier1"), F.col("has_official")
    return rows.select(
        "event_id",
        S.breaking_score(*breaking).alias("breaking_score"),
        S.gap_score(*gap).alias("gap_score"),
        F.struct(
            S.breaking_reasons(*breaking).alias("breaking"), S.gap_reasons(*gap).alias("gap")
        ).alias("reasons"),
        "velocity",
        "source_count",
        "max_evidence",
        "has_tier1",
        "computed_at",
    )


def alert_candidates(scores: DataFrame, threshold: float = fixed.ALERT_SCORE_THRESHOLD) -> DataFrame:
    return scores.filter(S.passes_alert_gate(F.col("breaking_score"), F.col("gap_score"), threshold))
