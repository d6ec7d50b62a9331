"""Canonical events: merging by identical anchors, audit rows and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.operators.graph import connected_components, resolve_roots
from storyspark.operators.hotkeys import HOT_ROWS, attach_unique
from storyspark.session import stage

MERGE_REASON = "SHARED_ANCHOR"


def merge_audit(
    event_docs: DataFrame, anchors: DataFrame, created_at: Column, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Absorbed events: all events linked by identical anchors become the lowest one.

    The evidence names how many anchors an absorbed event shares with others and the first of them.
    """
    held = stage(
        anchors.select("doc_id", "anchor_type", "anchor_value")
        .join(event_docs.select("doc_id", "event_id"), "doc_id")
        .select("event_id", F.to_json(F.struct("anchor_type", "anchor_value")).alias("anchor"))
        .distinct(),
        "event-anchors",
    )
    firsts = (
        held.groupBy("anchor").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    )
    shared = stage(attach_unique(held, firsts, "anchor", "n", hot_rows), "shared-anchors")
    components = connected_components(
        shared.select(F.col("event_id").alias("u"), F.col("first").alias("v")), hot_rows
    )
    evidence = shared.groupBy("event_id").agg(F.count("*").alias("shared_anchors"), F.min("anchor").alias("anchor"))
    return (
        components.filter("id <> root")
        .join(evidence, F.col("id") == F.col("event_id"))
        .select(
            F.col("id").alias("from_event_id"),
            F.col("root").alias("to_event_id"),
            F.lit(MERGE_REASON).alias("reason_code"),
            F.to_json(F.struct("shared_anchors", "anchor")).alias("evidence_json"),
            created_at.alias("created_at"),
        )
    )


def apply_merges(events: DataFrame, audit: DataFrame) -> DataFrame:
    """Mark absorbed events and point them at the event that absorbed them."""
    target = audit.select(F.col("from_event_id").alias("event_id"), F.col("to_event_id").alias("_to"))
    return (
        events.join(target, "event_id", "left")
        .withColumn("canonical_event_id", F.coalesce("_to", "canonical_event_id"))
        .withColumn("status", F.when(F.col("_to").isNotNull(), F.lit("MERGED")).otherwise(F.col("status")))
        .drop("_to")
    )


def resolve_redirects(audit: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Final target of every absorbed event, through any chain of merges."""
    parents = stage(
        audit.select(F.col("from_event_id").alias("id"), F.col("to_event_id").alias("parent")), "redirects"
    )
    return resolve_roots(parents, hot_rows).select(
        F.col("id").alias("from_event_id"), F.col("root").alias("to_event_id")
    )


def follow_redirects(event_docs: DataFrame, redirects: DataFrame) -> DataFrame:
    """Members of absorbed events as members of the event that took them in; only its own first document is primary."""
    target = redirects.select(F.col("from_event_id").alias("event_id"), F.col("to_event_id").alias("_to"))
    moved = event_docs.join(target, "event_id", "left").withColumn("event_id", F.coalesce("_to", "event_id")).drop("_to")
    return moved.withColumn("is_primary", F.col("event_id") == F.col("doc_id")).select(*event_docs.columns)
