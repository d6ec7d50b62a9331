"""Event assignment by shared anchors, and the attributes of new events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed
from storyspark.functions.text import non_empty
from storyspark.operators.graph import resolve_roots
from storyspark.operators.hotkeys import HOT_ROWS, attach_unique
from storyspark.session import stage


def assign_events(
    docs: DataFrame,
    anchors: DataFrame,
    match_on: tuple[str, ...] = ("anchor_value",),
    lookback_seconds: int | None = None,
    keep: tuple[str, ...] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``(event_id, doc_id, source_id, seen_at, is_primary)`` and the ``keep`` columns for every document.

    A document joins the event of the lowest document that shares one of its anchors; without such a document
    it opens an event of its own, named by its ``doc_id``. This equals taking documents one by one in
    ``doc_id`` order. A document that shares anchors with two events joins one and does not merge them.
    ``anchors`` is read several times: pass a written table.
    """
    if lookback_seconds is None:
        earlier = _earliest_sharing(anchors, match_on, hot_rows)
    else:
        earlier = _earliest_recent(docs, anchors, match_on, lookback_seconds)
    # Only documents that join an earlier one need a parent; all others are roots and stay out.
    children = stage(
        earlier.filter("first_doc < doc_id").select(F.col("doc_id").alias("id"), F.col("first_doc").alias("parent")),
        "parents",
    )
    roots = resolve_roots(children, hot_rows).select(F.col("id").alias("doc_id"), "root")
    return (
        docs.join(roots, "doc_id", "left")
        .withColumn("event_id", F.coalesce("root", "doc_id"))
        .select(
            "event_id",
            "doc_id",
            "source_id",
            "seen_at",
            (F.col("event_id") == F.col("doc_id")).alias("is_primary"),
            *keep,
        )
    )


def _earliest_sharing(anchors: DataFrame, match_on: tuple[str, ...], hot_rows: int) -> DataFrame:
    """Lowest document sharing an anchor, per document; values seen once are left out."""
    keyed = anchors.select("doc_id", _key(match_on).alias("anchor_key"))
    firsts = (
        keyed.groupBy("anchor_key")
        .agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    linked = attach_unique(keyed, firsts, "anchor_key", "n", hot_rows)
    return linked.groupBy("doc_id").agg(F.min("first_doc").alias("first_doc"))


#: Parts of a lookback: a hot value has a task for each of them. Whole seconds in microseconds are a multiple of it, so a window begins exactly so many parts earlier.
LOOKBACK_PARTS = 16


def _earliest_recent(
    docs: DataFrame, anchors: DataFrame, match_on: tuple[str, ...], lookback_seconds: int
) -> DataFrame:
    """Like :func:`_earliest_sharing`, over documents seen at most ``lookback_seconds`` earlier.

    Time is cut in parts of the lookback. The least document of a window is that of its own part up to the row, of the whole parts before
    it, known by one row each, and of the part in which the window begins, from there on. So no task sorts more than one part of a value.
    """
    width = -(-lookback_seconds * 1_000_000 // LOOKBACK_PARTS)
    span = lookback_seconds * 1_000_000
    seen = anchors.select("doc_id", _key(match_on).alias("anchor_key")).join(
        docs.select("doc_id", F.unix_micros("seen_at").alias("t")), "doc_id"
    )
    points = seen.groupBy("anchor_key", "t").agg(F.min("doc_id").alias("d"))
    # Each time is a place in its own part, with its least document, and the place without one where its window begins.
    places = F.array(
        F.struct(F.col("t").alias("place"), F.col("d").alias("own"), F.lit(False).alias("begins")),
        F.struct((F.col("t") - span).alias("place"), F.lit(None).cast("bigint").alias("own"), F.lit(True).alias("begins")),
    )
    marks = stage(points.select("anchor_key", "t", F.inline(places)).withColumn("part", F.floor(F.col("place") / width)), "lookback-marks")
    inside = W.partitionBy("anchor_key", "part").orderBy("place")
    edge = F.when(F.col("begins"), F.min("own").over(inside.rangeBetween(0, W.unboundedFollowing))).otherwise(
        F.min("own").over(inside.rangeBetween(W.unboundedPreceding, 0))
    )
    edges = marks.withColumn("edge", edge)
    minima = marks.groupBy("anchor_key", "part").agg(F.min("own").alias("least"))
    before = W.partitionBy("anchor_key").orderBy("part")
    whole = minima.select("anchor_key", "part", F.min("least").over(before.rangeBetween(1 - LOOKBACK_PARTS, -1)).alias("between"))
    # Where a window begins its part is cut; the parts between that one and the row's are whole.
    firsts = (
        edges.join(whole, ["anchor_key", "part"])
        .groupBy("anchor_key", "t")
        .agg(F.min(F.when(F.col("begins"), F.col("edge")).otherwise(F.least("edge", "between"))).alias("first_doc"))
    )
    return seen.join(firsts, ["anchor_key", "t"]).groupBy("doc_id").agg(F.min("first_doc").alias("first_doc"))


def _key(match_on: tuple[str, ...]) -> Column:
    return F.col(match_on[0]) if len(match_on) == 1 else F.to_json(F.struct(*match_on))


EVENT_COLUMNS = ("title", "lane", "tier", "source_domain")


def build_events(event_docs: DataFrame) -> DataFrame:
    """One row per event with its starting status, score, lane and summary.

    ``event_docs`` carries :data:`EVENT_COLUMNS` of its documents; the first document of an event decides.
    """
    hot_status, hot_score = fixed.TIER1_EVENT
    new_status, new_score = fixed.OTHER_EVENT
    first = F.struct("seen_at", *EVENT_COLUMNS)
    grouped = (
        event_docs.groupBy("event_id")
        .agg(F.max("seen_at").alias("last_seen_at"), F.max(F.when(F.col("is_primary"), first)).alias("first"))
        .filter("first IS NOT NULL")
        .select("event_id", "last_seen_at", "first.*")
    )
    tier1 = F.col("tier") == 1
    summary = F.coalesce(
        non_empty(F.col("title")), F.concat(F.lit(fixed.DEFAULT_SUMMARY_PREFIX), F.col("source_domain"))
    )
    return grouped.select(
        "event_id",
        F.lit(None).cast("bigint").alias("canonical_event_id"),
        F.when(tier1, F.lit(hot_status)).otherwise(F.lit(new_status)).alias("status"),
        summary.alias("summary"),
        "lane",
        F.when(tier1, F.lit(hot_score)).otherwise(F.lit(new_score)).alias("breaking_score"),
        F.col("seen_at").alias("first_seen_at"),
        "last_seen_at",
        F.col("seen_at").alias("created_at"),
    )
