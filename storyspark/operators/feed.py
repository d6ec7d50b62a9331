"""Ranked feeds, dashboard cards and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed
from storyspark.functions.scores import coverage_lag, evidence_multiplier
from storyspark.functions.text import non_empty
from storyspark.session import stage

FEED_LIMIT = 20
CARD_LIMIT = 12
CARD_ANCHORS = 3
CARD_ANCHOR_CHARS = 15
ANCHORS_PER_PAGE = 1_000


def top_events(
    events: DataFrame, status: str | None = None, lane: str | None = None, limit: int = FEED_LIMIT
) -> DataFrame:
    """Best events by score, then recency, then id. An empty filter value means no filter."""
    if status:
        events = events.filter(F.col("status") == status)
    if lane:
        events = events.filter(F.col("lane") == lane)
    return (
        events.select("event_id", "status", "summary", F.col("breaking_score").alias("score"), "lane", "created_at")
        .orderBy(F.col("score").desc(), F.col("created_at").desc(), F.col("event_id"))
        .limit(limit)
    )


def _anchor_counts(top: DataFrame, event_docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distinct anchors with their number of mentions, for the events of ``top``."""
    members = event_docs.select("event_id", "doc_id").join(top.select("event_id"), "event_id")
    return (
        anchors.select("doc_id", "anchor_type", "anchor_value")
        .join(members, "doc_id")
        .groupBy("event_id", "anchor_type", "anchor_value")
        .agg(F.count("*").alias("mentions"))
    )


def feed_anchors(
    events: DataFrame,
    event_docs: DataFrame,
    anchors: DataFrame,
    status: str | None = None,
    lane: str | None = None,
    limit: int = FEED_LIMIT,
) -> DataFrame:
    """All anchors of the top events, one row per event and anchor: ``event_id, anchor_type, anchor_value, mentions``."""
    return _anchor_counts(stage(top_events(events, status, lane, limit), "feed-top"), event_docs, anchors)


def event_feed(
    events: DataFrame,
    event_docs: DataFrame,
    anchors: DataFrame,
    status: str | None = None,
    lane: str | None = None,
    limit: int = FEED_LIMIT,
) -> DataFrame:
    """Top events with the number of their distinct anchors, of all mentions of them, and all anchors as ``array<struct<type, value, mentions>>``.

    An event with more than a thousand distinct anchors spreads them over numbered pages, a row each, so that no row or task has to hold them
    all; the counts of the event are on every page. :func:`feed_anchors` lists the same anchors one row each.
    """
    top = stage(top_events(events, status, lane, limit), "feed-top")
    counts = stage(_anchor_counts(top, event_docs, anchors), "feed-anchors")
    sizes = counts.groupBy("event_id").agg(F.count("*").alias("anchor_count"), F.sum("mentions").alias("mentions"))
    bucket = F.conv(F.substring(F.md5(F.col("anchor_value").cast("binary")), 1, 8), 16, 10).cast("bigint")
    item = F.struct(F.col("anchor_type").alias("type"), F.col("anchor_value").alias("value"), "mentions")
    nested = (
        counts.join(sizes.select("event_id", "anchor_count"), "event_id")
        .withColumn("anchor_page", F.pmod(bucket, F.ceil(F.col("anchor_count") / ANCHORS_PER_PAGE)))
        .groupBy("event_id", "anchor_page")
        .agg(F.sort_array(F.collect_list(item)).alias("anchors"))
    )
    none = F.lit(0).cast("bigint")
    return (
        top.join(sizes, "event_id", "left")
        .join(nested, "event_id", "left")
        .select(
            "event_id",
            "status",
            "summary",
            "score",
            "lane",
            "created_at",
            *(F.coalesce(c, none).alias(c) for c in ("anchor_count", "mentions", "anchor_page")),
            F.coalesce("anchors", F.array().cast("array<struct<type:string,value:string,mentions:bigint>>")).alias("anchors"),
        )
        .orderBy(F.col("score").desc(), F.col("created_at").desc(), "event_id", "anchor_page")
    )


def dashboard_cards(
    events: DataFrame,
    event_docs: DataFrame,
    anchors: DataFrame,
    limit: int = CARD_LIMIT,
    tags_per_card: int = CARD_ANCHORS,
    tag_chars: int = CARD_ANCHOR_CHARS,
) -> DataFrame:
    """The best events that are not ignored, with a few short anchor tags each."""
    top = stage(top_events(events.filter(F.col("status") != "IGNORED"), limit=limit), "card-top")
    first = W.partitionBy("event_id").orderBy("anchor_type", "anchor_value")
    tag = F.concat(F.col("anchor_type"), F.lit(": "), F.substring("anchor_value", 1, tag_chars))
    tags = (
        _anchor_counts(top, event_docs, anchors)
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= tags_per_card)
        .groupBy("event_id")
        .agg(F.sort_array(F.collect_list(F.struct("n", tag.alias("tag")))).alias("tags"))
        .select("event_id", F.transform("tags", lambda t: t["tag"]).alias("tags"))
    )
    return top.join(tags, "event_id", "left").select(
        "event_id",
        "status",
        F.coalesce(non_empty(F.col("lane")), F.lit(fixed.DEFAULT_LANE)).alias("lane"),
        F.coalesce(non_empty(F.col("summary")), F.lit(fixed.NO_SUMMARY)).alias("summary"),
        F.concat(F.col("score").cast("int"), F.lit("%")).alias("score_label"),
        F.date_format("created_at", "HH:mm").alias("created_label"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def gap_ranking(events: DataFrame, scores: DataFrame, limit: int = FEED_LIMIT) -> DataFrame:
    """Events by evidence-gap score, with the evidence multiplier and coverage lag behind it."""
    return (
        scores.join(events.select("event_id", "status", "lane"), "event_id")
        .select(
            "event_id",
            "status",
            "lane",
            "gap_score",
            "max_evidence",
            evidence_multiplier(F.col("max_evidence")).alias("evidence_multiplier"),
            coverage_lag(F.col("has_tier1")).alias("coverage_lag"),
        )
        .orderBy(F.col("gap_score").desc(), F.col("event_id"))
        .limit(limit)
    )


def dashboard_counts(sources: DataFrame, events: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: number of sources, hot events, new events and documents."""
    zero = F.lit(0).cast("bigint")
    names = ("sources_count", "events_hot", "events_new", "docs_count")

    def row(df: DataFrame, **counts) -> DataFrame:
        return df.agg(*[c.alias(n) for n, c in counts.items()]).select(
            *[F.col(n) if n in counts else zero.alias(n) for n in names]
        )

    parts = (
        row(sources, sources_count=F.count("*"))
        .unionByName(
            row(
                events,
                events_hot=F.count_if(F.col("status") == "HOT"),
                events_new=F.count_if(F.col("status") == "NEW"),
            )
        )
        .unionByName(row(docs, docs_count=F.count("*")))
    )
    return parts.agg(*[F.sum(n).alias(n) for n in names])
