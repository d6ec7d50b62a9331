"""Writing results: appended tables, upserted scores, drafts and the feedback log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed
from storyspark.functions.deltas import iso_time


def append_tables(tables: dict[str, DataFrame], folder: str, batch_id: int | str) -> None:
    """Write one batch of several tables below ``folder``.

    Each table gets a partition per batch, and a repeated batch replaces exactly that partition, so a
    retried or replayed batch never duplicates rows.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")


def latest_scores(scores: DataFrame) -> DataFrame:
    """One row per event: the one computed last, of several at one time the largest by its other columns.

    Combines before the shuffle, so hot events are cheap.
    """
    row = F.struct("computed_at", *[F.col(c) for c in scores.columns if c != "computed_at"])
    latest = scores.groupBy("event_id").agg(F.max(row).alias("_row"))
    return latest.select(*[F.col("_row")[c].alias(c) for c in scores.columns])


def upsert_scores(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming scores replace stored ones of the same event; all other rows stay."""
    fresh = latest_scores(incoming)
    return stored.join(fresh.select("event_id"), "event_id", "left_anti").unionByName(fresh)


def mirror_scores(events: DataFrame, scores: DataFrame) -> DataFrame:
    """Events with their computed breaking score; events not yet scored keep their starting score."""
    fresh = scores.select("event_id", F.col("breaking_score").alias("_score"))
    return (
        events.join(fresh, "event_id", "left")
        .withColumn("breaking_score", F.coalesce("_score", "breaking_score"))
        .drop("_score")
    )


def draft_articles(events: DataFrame, created_at: Column) -> DataFrame:
    """``(event_id, draft_json)``: one unpublished article per event.

    ``events``: ``event_id, title, clean_text, sources, anchors, evidence_score, reasons, timeline,
    confidence``. The review keys exist only for a known confidence below the threshold.
    """
    weak = F.coalesce("confidence", F.lit(1.0)) < fixed.DRAFT_REVIEW_BELOW
    article = F.struct(
        "title",
        F.lit("DRAFT").alias("status"),
        F.col("clean_text").alias("body"),
        F.col("sources").alias("provenance"),
        F.struct(
            "anchors", F.coalesce("evidence_score", F.lit(0.0)).alias("evidence_score"), "reasons"
        ).alias("evidence"),
        "timeline",
        iso_time(created_at).alias("created_at"),
        F.when(weak, F.lit(True)).alias("needs_review"),
        F.when(weak, F.lit(fixed.DRAFT_REVIEW_REASON)).alias("review_reason"),
    )
    return events.select("event_id", F.to_json(article).alias("draft_json"))


def check_feedback(feedback: DataFrame) -> DataFrame:
    """Add ``actor`` and ``is_valid`` to raw editorial actions; invalid ones are for the caller to reject."""
    user = F.get_json_object("payload_json", "$.user_id")
    return feedback.withColumns(
        {
            "actor": F.coalesce(user, F.lit(fixed.ANONYMOUS_ACTOR)),
            "is_valid": F.coalesce(F.col("action").isin(*fixed.FEEDBACK_ACTIONS), F.lit(False)),
        }
    )


def apply_feedback(events: DataFrame, feedback: DataFrame) -> DataFrame:
    """Optional: events with an IGNORE action become IGNORED. The log alone leaves events unchanged."""
    ignored = check_feedback(feedback).filter("is_valid AND action = 'IGNORE'").select("event_id").distinct()
    return (
        events.join(ignored.withColumn("_ignored", F.lit(True)), "event_id", "left")
        .withColumn("status", F.when(F.col("_ignored"), F.lit("IGNORED")).otherwise(F.col("status")))
        .drop("_ignored")
    )
