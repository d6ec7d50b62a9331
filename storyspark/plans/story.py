"""The main path: documents to anchors, events, scores and the ranked feed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions.taxonomy import editorial_lane
from storyspark.operators.assign import EVENT_COLUMNS, assign_events, build_events
from storyspark.operators.evidence import FEATURES, explode_anchors, with_evidence
from storyspark.operators.merge import follow_redirects, merge_audit, resolve_redirects
from storyspark.operators.scoring import score_events
from storyspark.session import stage
from storyspark.sinks.tables import mirror_scores


@dataclass
class StoryTables:
    """Results of one run, as DataFrames over written tables."""

    facts: DataFrame
    anchors: DataFrame
    event_docs: DataFrame
    events: DataFrame
    scores: DataFrame
    redirects: DataFrame | None = None

    def features(self) -> DataFrame:
        return self.facts.select("doc_id", *FEATURES)

    def scored_events(self) -> DataFrame:
        """Events with the computed score in place of the starting one."""
        return mirror_scores(self.events, self.scores)


def with_lane(docs: DataFrame, lane_chars: int | None = None) -> DataFrame:
    """Lane of each document from its title and its text, hinted by ``source_key``.

    ``lane_chars`` looks at so many characters of the text only; 500 is what short feed items were tuned for.
    """
    text = F.col("clean_text") if lane_chars is None else F.substring("clean_text", 1, lane_chars)
    return docs.withColumn("lane", editorial_lane(title=F.col("title"), snippet=text, editoria=F.col("source_key")))


def document_facts(docs: DataFrame, with_context: bool = False, lane_chars: int | None = None) -> DataFrame:
    """All that later steps need of a document, without its text: the only scan of the text.

    ``with_context`` also keeps the characters around every anchor; ``lane_chars`` as in :func:`with_lane`. ``title`` is the raw
    title: a default in its place would vote for a lane and stand in summaries.

    ``docs``: ``doc_id, source_id, source_key, source_domain, tier, is_official, title, url, clean_text, seen_at``.
    """
    facts = with_evidence(with_lane(docs, lane_chars), with_context).select(
        "doc_id", "source_id", "seen_at", *EVENT_COLUMNS, "anchors", *FEATURES
    )
    return stage(facts, "document-facts")


def assign_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchor rows and event members of document facts."""
    anchors = explode_anchors(facts)
    kept = (*EVENT_COLUMNS, "evidence_score")
    return anchors, stage(assign_events(facts, anchors, keep=kept), "event-docs")


def build_story(docs: DataFrame, sources: DataFrame, as_of: Column | None = None, merge: bool = False) -> StoryTables:
    """Run the main path over all documents; ``as_of`` defaults to the latest sighting.

    With ``merge`` events that share identical anchors are one: documents, scores and feeds are those of the canonical event,
    ``events`` has no absorbed event, and ``redirects`` (``from_event_id, to_event_id``) leads from those to their targets.
    """
    facts = document_facts(docs)
    anchors, event_docs = assign_facts(facts)
    now = facts.agg(F.max("seen_at")).scalar() if as_of is None else as_of
    redirects = None
    if merge:
        redirects = stage(resolve_redirects(merge_audit(event_docs, anchors, now)), "redirects")
        event_docs = stage(follow_redirects(event_docs, redirects), "canonical-docs")
    events = stage(build_events(event_docs), "events")
    scores = stage(score_events(events, event_docs, sources, now), "event-scores")
    return StoryTables(facts, anchors, event_docs, events, scores, redirects)
