"""Timeouts, alerts and changes of streams: the batch operators, applied to rows in event-time order.

Each takes the stream, a session, the folder of its output and state, and how late rows may be, and returns the output so far.
What is kept between batches is at most a row or two per event, read and written for the events of a batch only, and for timeouts only the states that
can still time out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed
from storyspark.operators import alerts, changes, states
from storyspark.operators.hotkeys import with_next
from storyspark.session import stage
from storyspark.streaming.ordered import run_ordered

LATE_S = 3600
TRANSITION = "event_id bigint, old_status string, status string, at timestamp"
ALERT = "event_id bigint, observation_id bigint, alert_hash string, last_alert_at timestamp, cooldown_until timestamp"
CHANGE = "event_id bigint, change string, status string, target_event_id bigint"
EVENT = "event_id bigint, canonical_event_id bigint, status string, summary string, lane string, breaking_score double, updated_at timestamp"


def state_timeouts(log: DataFrame, spark: SparkSession, folder: str, late_by_s: int = LATE_S, every: str | None = None) -> DataFrame:
    """Timeouts of a stream of states ``event_id, status, pool, at``; see :func:`states.timed_transitions`."""
    columns = ["event_id", "status", "pool", "at"]

    def step(open_states: DataFrame, rows: DataFrame, horizon: Column) -> tuple[DataFrame, DataFrame]:
        both = open_states.unionByName(rows).withColumn("_order", F.struct("at", "status", "pool"))
        following = with_next(both, ["event_id"], "_order", F.date_trunc("hour", "at"), F.struct("at"), "_next")
        read = stage(following.select(*columns, F.col("_next.at").alias("next_at")), "state-log")
        undecided = read.filter(F.col("next_at").isNull() & (states.deadline(F.col("status"), F.col("pool"), F.col("at")) >= horizon))
        return states.timed_transitions(read, horizon), undecided.select(*columns)

    return run_ordered(log.select(*columns), spark, folder, "at", late_by_s, "event_id bigint, status string, pool string, at timestamp", TRANSITION, step, every)


def sent_alerts(
    observations: DataFrame, spark: SparkSession, folder: str, cooldown_s: int = fixed.ALERT_COOLDOWN_S, late_by_s: int = LATE_S, every: str | None = None
) -> DataFrame:
    """Alerts of a stream of observations; see :func:`alerts.alert_transitions` and :func:`alerts.sent_alerts`.

    Kept per event: its last observation, and its last alert while that still silences it.
    """
    columns = ["event_id", "observation_id", "observed_at", "status", "gate"]

    def step(state: DataFrame, rows: DataFrame, horizon: Column) -> tuple[DataFrame, DataFrame]:
        seen = state.filter("kind = 'seen'").select(*columns)
        before = state.filter("kind = 'sent'").select("event_id", "observation_id", "observed_at", F.lit("").alias("alert_hash"))
        every_row = stage(seen.unionByName(rows), "observations")
        candidates = stage(alerts.alert_transitions(every_row).unionByName(before), "alert-candidates")
        sent = stage(alerts.sent_alerts(candidates, cooldown_s), "alerts-sent")
        new = sent.filter("observation_id >= 0")
        last = every_row.groupBy("event_id").agg(F.max(F.struct("observed_at", "observation_id", "status")).alias("s"))
        last = last.select("event_id", "s.observation_id", "s.observed_at", "s.status", F.lit(False).alias("gate"), F.lit("seen").alias("kind"))
        silent = sent.groupBy("event_id").agg(F.max("last_alert_at").alias("observed_at"), F.max("cooldown_until").alias("until")).filter(F.col("until") > horizon)
        silent = silent.select("event_id", F.lit(-1).cast("bigint").alias("observation_id"), "observed_at", F.lit("").alias("status"), F.lit(False).alias("gate"), F.lit("sent").alias("kind"))
        return new, last.unionByName(silent)

    schema = "event_id bigint, observation_id bigint, observed_at timestamp, status string, gate boolean, kind string"
    return run_ordered(observations.select(*columns), spark, folder, "observed_at", late_by_s, schema, ALERT, step, every, "event_id")


def event_changes(events: DataFrame, spark: SparkSession, folder: str, late_by_s: int = LATE_S, every: str | None = None) -> DataFrame:
    """Change feed of a stream of event rows with ``updated_at``; see :func:`changes.change_log`. Kept: the last row of each event."""
    columns = [f.split()[0] for f in EVENT.split(", ")]

    def step(known: DataFrame, rows: DataFrame, horizon: Column) -> tuple[DataFrame, DataFrame]:
        row = F.struct("updated_at", *[c for c in columns if c not in ("updated_at", "event_id")])
        last = known.unionByName(rows).groupBy("event_id").agg(F.max(row).alias("r"))
        return changes.change_log(rows, known), last.select("event_id", *[F.col("r")[c].alias(c) for c in columns[1:]])

    return run_ordered(events.select(*columns), spark, folder, "updated_at", late_by_s, EVENT, CHANGE, step, every, "event_id")
