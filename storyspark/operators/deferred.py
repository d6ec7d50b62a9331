"""Merging events batch by batch: only what a batch links is contracted, and merges take effect after a while.

Stored are the first event of every anchor and the redirects so far, both cut to buckets. A batch looks up the anchors that it holds, maps the events
that these link to where they stand now, and finds the components of those few alone. Each absorbed event gets one redirect, with the time
from which it counts, so that editors can object to a merge before readers see it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.operators.graph import connected_components
from storyspark.operators.hotkeys import HOT_ROWS, attach_unique
from storyspark.operators.merge import resolve_redirects
from storyspark.session import stage
from storyspark.sinks.bucketed import BucketTable

#: Seconds between finding a merge and applying it.
TOLERANCE_S = 900


@dataclass
class MergeStore:
    """Tables of merges below a folder; a batch that is repeated replaces what it wrote."""

    spark: SparkSession
    folder: str
    tolerance_s: int = TOLERANCE_S
    n_buckets: int = 64

    def __post_init__(self) -> None:
        self.index = BucketTable(self.spark, f"{self.folder}/anchors", "anchor string, first_event bigint", "anchor", self.n_buckets)
        schema = "from_event_id bigint, to_event_id bigint, created_at timestamp, due_at timestamp"
        self.redirects = BucketTable(self.spark, f"{self.folder}/redirects", schema, "from_event_id", self.n_buckets)

    def add(self, event_docs: DataFrame, anchors: DataFrame, batch_id: int, created_at: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
        """Take a batch of members ``event_id, doc_id`` and their anchors; returns its redirects ``from_event_id, to_event_id, created_at, due_at``."""
        held = stage(
            anchors.select("doc_id", "anchor_type", "anchor_value")
            .join(event_docs.select("doc_id", "event_id"), "doc_id")
            .select("event_id", F.to_json(F.struct("anchor_type", "anchor_value")).alias("anchor"))
            .distinct(),
            "held-anchors",
        )
        stored = self.index.read(self.index.buckets_of(held), batch_id)
        firsts = stage(held.groupBy("anchor").agg(F.min("event_id").alias("first"), F.count("*").alias("n")).join(stored, "anchor", "left"), "batch-anchors")
        linking = firsts.filter("n > 1 OR first_event IS NOT NULL").select("anchor", "n", F.coalesce("first_event", "first").alias("hub"))
        edges = stage(attach_unique(held, linking, "anchor", "n", hot_rows).filter("event_id <> hub").select("event_id", "hub").distinct(), "batch-edges")
        ends = edges.select(F.explode(F.array("event_id", "hub")).alias("id")).distinct()
        now = self._standing(ends, batch_id)
        of = lambda name: now.select(F.col("id").alias(name), F.col("root").alias(f"{name}_root"))
        between = edges.join(of("event_id"), "event_id").join(of("hub"), "hub").select(F.col("event_id_root").alias("u"), F.col("hub_root").alias("v"))
        due = F.timestamp_micros(F.unix_micros(created_at) + self.tolerance_s * 1_000_000)
        merged = connected_components(between, hot_rows).filter("id <> root")
        deltas = stage(merged.select(F.col("id").alias("from_event_id"), F.col("root").alias("to_event_id"), created_at.alias("created_at"), due.alias("due_at")), "batch-merges")
        self.redirects.append(deltas, batch_id)
        # Only anchors that were not known: their number follows the batch.
        self.index.append(firsts.filter("first_event IS NULL").select("anchor", F.col("first").alias("first_event")), batch_id)
        return deltas

    def _standing(self, ids: DataFrame, batch_id: int) -> DataFrame:
        """``id, root``: where events stand after the batches before, due or not. A step opens the buckets of the events that still move."""
        now = stage(ids.select("id", F.col("id").alias("root")), "merge-roots")
        moving = now
        while True:
            steps = self.redirects.read(self.redirects.buckets_of(moving, "root"), batch_id).select(F.col("from_event_id").alias("root"), F.col("to_event_id").alias("_next"))
            stepped = stage(now.join(steps, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "merge-roots")
            now, moving = stepped.drop("moved"), stepped.filter("moved")
            if moving.isEmpty():
                return now

    def applied(self, as_of: Column) -> DataFrame:
        """``from_event_id, to_event_id``: final targets by the merges that are due at a time."""
        return resolve_redirects(self.redirects.read().filter(F.col("due_at") <= as_of))
