"""Change feed between two snapshots of the events, and editorial feedback statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed
from storyspark.operators.hotkeys import with_previous

_WATCHED = ("summary", "lane", "breaking_score", "canonical_event_id")


def change_feed(old: DataFrame, new: DataFrame) -> DataFrame:
    """``event_id, change, status, target_event_id`` for every event that is new or different.

    A merge is reported as such, also when it moves on to another target, any other new status as a state change, and everything
    else as an upsert.
    Unchanged events and events that only exist in ``old`` give no row.
    """
    before = old.select("event_id", *[F.col(c).alias(f"old_{c}") for c in ("status", *_WATCHED)], F.lit(True).alias("known"))
    return _changed(new.join(before, "event_id", "left"), F.col("known").isNotNull(), lambda c: F.col(f"old_{c}"))


def change_log(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The changes of a log of event rows: each row against the one before, the first against ``known`` (one row per event).

    ``rows`` and ``known`` have the columns of events and ``updated_at``; rows of one time follow each other by their other columns.
    """
    watched = ("status", *_WATCHED)
    both = known.withColumn("_new", F.lit(False)).unionByName(rows.withColumn("_new", F.lit(True)))
    ordered = both.withColumn("_order", F.struct("updated_at", *watched))
    seen = with_previous(ordered, ["event_id"], "_order", F.date_trunc("hour", "updated_at"), F.struct(*watched), "_before")
    return _changed(seen.filter("_new"), F.col("_before").isNotNull(), lambda c: F.col("_before")[c])


def _changed(rows: DataFrame, known: Column, old: Callable[[str], Column]) -> DataFrame:
    moved = ~F.col("status").eqNullSafe(old("status"))
    touched = ~known
    for name in _WATCHED:
        touched = touched | ~F.col(name).eqNullSafe(old(name))
    retargeted = moved | ~F.col("canonical_event_id").eqNullSafe(old("canonical_event_id"))
    change = (
        F.when(known & retargeted & (F.col("status") == "MERGED"), F.lit("EVENT_MERGED"))
        .when(known & moved, F.lit("EVENT_STATE_CHANGED"))
        .when(touched, F.lit("EVENT_UPSERT"))
    )
    target = F.when(F.col("status") == "MERGED", F.col("canonical_event_id"))
    return (
        rows.withColumn("change", change)
        .filter("change IS NOT NULL")
        .select("event_id", "change", "status", target.alias("target_event_id"))
    )


def feedback_stats(feedback: DataFrame, events: DataFrame, by: str, redirects: DataFrame | None = None) -> DataFrame:
    """Counts of each valid action and the share of ignored ones, per lane or source of the event.

    Actions are summed per event before the join, so an event with very many of them is one row per action. With
    ``redirects`` (``from_event_id, to_event_id``) actions on an absorbed event count for the event that took it in.
    """
    actions = (
        feedback.filter(F.col("action").isin(*fixed.FEEDBACK_ACTIONS))
        .groupBy("event_id", "action")
        .agg(F.count("*").alias("n"))
    )
    if redirects is not None:
        to = redirects.select(F.col("from_event_id").alias("event_id"), "to_event_id")
        actions = actions.join(to, "event_id", "left").withColumn("event_id", F.coalesce("to_event_id", "event_id")).drop("to_event_id")
    named = actions.join(events.select("event_id", by), "event_id")

    def total(action: str):
        return F.coalesce(F.sum(F.when(F.col("action") == action, F.col("n"))), F.lit(0).cast("bigint"))

    counts = [total(a).alias(f"n_{a.lower()}") for a in fixed.FEEDBACK_ACTIONS]
    return named.groupBy(by).agg(F.sum("n").alias("n_actions"), *counts).withColumn(
        "ignored_rate", F.col("n_ignore") / F.col("n_actions")
    )
