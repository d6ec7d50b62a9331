"""Micro-batch ingest: extracted tables and events per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.operators.evidence import FEATURES, explode_anchors
from storyspark.operators.incremental import EventStore
from storyspark.plans.story import document_facts
from storyspark.sinks.tables import append_tables
from storyspark.streaming.runner import for_each_batch


def ingest_documents(docs: DataFrame, sources: DataFrame, spark: SparkSession, folder: str, every: str | None = None, n_buckets: int = 64) -> EventStore:
    """Append documents, anchors, evidence features, events and scores of every micro-batch below ``folder``.

    ``docs`` has the columns that ``document_facts`` asks for. A replayed batch overwrites its own partition of each table, and the
    checkpoint lies in the folder, so a second start goes on with new batch numbers. Texts are written once, as the documents
    of the batch; all else is read from there. Later batches must have greater ids.
    """
    store = EventStore(spark, folder, n_buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_tables({"documents": batch}, folder, batch_id)
        stored = spark.read.schema(batch.schema).parquet(f"{folder}/documents/batch_id={batch_id}")
        facts = document_facts(stored, with_context=True)
        append_tables({"doc_anchors": explode_anchors(facts), "doc_evidence_features": facts.select("doc_id", *FEATURES)}, folder, batch_id)
        anchors = spark.read.parquet(f"{folder}/doc_anchors/batch_id={batch_id}").select("doc_id", "anchor_type", "anchor_value")
        store.add(facts, anchors, sources, batch_id, F.coalesce(facts.agg(F.max("seen_at")).scalar(), F.current_timestamp()))

    for_each_batch(docs, spark, f"{folder}/_checkpoint", write, every)
    return store
