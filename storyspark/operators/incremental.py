"""Assigning a batch of new documents to events that are already stored.

Stored state is one row per anchor value, ``anchor_value, first_doc, event_id``, and the members and attributes of the events, each table cut to buckets by
hash of the value or the event. A batch opens only the buckets that its values and the events that it touches fall in; it never reads others. Ids of later batches must be greater, as for taking documents one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.operators.assign import EVENT_COLUMNS, build_events
from storyspark.operators.graph import resolve_roots
from storyspark.operators.hotkeys import HOT_ROWS, attach_unique
from storyspark.operators.scoring import score_events
from storyspark.schemas import EVENTS
from storyspark.session import stage
from storyspark.sinks.bucketed import BucketTable

INDEX = "anchor_value string, first_doc bigint, event_id bigint"
KEPT = (*EVENT_COLUMNS, "evidence_score")
MEMBERS = (
    "event_id bigint, doc_id bigint, source_id bigint, seen_at timestamp, title string, lane string, tier int, source_domain string, "
    "evidence_score double, is_primary boolean"
)
SCORES = (
    "event_id bigint, breaking_score double, gap_score double, reasons struct<breaking:array<string>,gap:array<string>>, velocity bigint, "
    "source_count bigint, max_evidence double, has_tier1 boolean, computed_at timestamp"
)


def assign_batch(facts: DataFrame, anchors: DataFrame, index: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(event_docs, new index rows)`` of a batch of documents, against the stored ``index``.

    A document joins the event of the lowest document, stored or in the batch, that shares one of its anchors. Taken batch after
    batch this gives the rows of :func:`assign_events` over all documents. ``anchors`` and ``index`` are read several times.
    """
    values = anchors.select("doc_id", "anchor_value")
    firsts = values.groupBy("anchor_value").agg(F.min("doc_id").alias("batch_first"), F.count("*").alias("n"))
    known = stage(firsts.join(index, "anchor_value", "left"), "batch-values")
    # Values of one document that are new can link nothing.
    linking = known.filter("n > 1 OR first_doc IS NOT NULL").select("anchor_value", "n", F.struct(F.coalesce("first_doc", "batch_first").alias("doc"), "event_id").alias("first"))
    earliest = attach_unique(values, linking, "anchor_value", "n", hot_rows).groupBy("doc_id").agg(F.min("first").alias("first"))
    linked = stage(earliest.select("doc_id", "first.doc", "first.event_id"), "batch-links")
    inside = linked.filter("event_id IS NULL AND doc < doc_id").select(F.col("doc_id").alias("id"), F.col("doc").alias("parent"))
    roots = resolve_roots(stage(inside, "batch-parents"), hot_rows).select(F.col("id").alias("doc_id"), "root")
    stored = linked.filter("event_id IS NOT NULL").select(F.col("doc_id").alias("root"), F.col("event_id").alias("stored_event"))
    placed = facts.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")).join(stored, "root", "left")
    event_docs = placed.select(
        F.coalesce("stored_event", "root").alias("event_id"), "doc_id", "source_id", "seen_at", *KEPT
    ).withColumn("is_primary", F.col("event_id") == F.col("doc_id"))
    event_docs = stage(event_docs, "batch-event-docs")
    fresh = known.filter("first_doc IS NULL").select("anchor_value", "n", F.col("batch_first").alias("first_doc"))
    # One row per value: the first document of a value has one event, so this join adds no rows.
    rows = fresh.join(event_docs.select(F.col("doc_id").alias("first_doc"), "event_id"), "first_doc")
    return event_docs, rows.select("anchor_value", "first_doc", "event_id")


@dataclass
class EventStore:
    """Tables of events below a folder that a job of any later day can go on with; see :class:`BucketTable`.

    A batch opens the buckets of the anchor values, and then of the events, that it touches; what lies in others is not read, whatever
    their size. A batch that is repeated replaces exactly what it wrote, so a retry changes nothing.
    """

    spark: SparkSession
    folder: str
    n_buckets: int = 64

    def __post_init__(self) -> None:
        def table(name: str, schema: str, key: str) -> BucketTable:
            return BucketTable(self.spark, f"{self.folder}/{name}", schema, key, self.n_buckets)

        self.index = table("anchor_index", INDEX, "anchor_value")
        self.members = table("event_docs", MEMBERS, "event_id")
        self.event_rows = table("events", EVENTS, "event_id")
        self.score_rows = table("event_scores", SCORES, "event_id")

    def add(self, facts: DataFrame, anchors: DataFrame, sources: DataFrame, batch_id: int, as_of: Column | None = None) -> DataFrame:
        """Store a batch of document facts and their anchors; returns the scores of the events that it touched.

        ``as_of`` defaults to the latest sighting of the batch.
        """
        index = self.index.read(self.index.buckets_of(anchors, "anchor_value"), batch_id)
        event_docs, rows = assign_batch(facts, anchors, index)
        touched = stage(event_docs.select("event_id").distinct(), "batch-events")
        before = self.members.read(self.members.buckets_of(touched), batch_id).join(touched, "event_id", "left_semi")
        members = stage(before.unionByName(event_docs.select(*before.columns)), "batch-members")
        events = stage(build_events(members), "batch-new-events")
        now = facts.agg(F.max("seen_at")).scalar() if as_of is None else as_of
        scores = stage(score_events(events, members, sources, now), "batch-scores")
        self.index.append(stage(rows, "batch-index"), batch_id)
        self.members.append(event_docs, batch_id)
        self.event_rows.upsert(events, batch_id)
        self.score_rows.upsert(scores, batch_id)
        return scores

    def event_docs(self) -> DataFrame:
        return self.members.read()

    def events(self) -> DataFrame:
        """The row that the last batch to touch an event wrote."""
        return self.event_rows.read()

    def scores(self) -> DataFrame:
        return self.score_rows.read()
