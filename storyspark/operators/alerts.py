"""Which observations of events raise an alert: transitions, then a cooldown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed
from storyspark.operators.hotkeys import with_previous
from storyspark.session import stage


def alert_hash(event_id: Column, status: Column) -> Column:
    return F.sha2(F.concat_ws("|", event_id.cast("string"), status), 256)


def alert_transitions(observations: DataFrame, grain: str = "hour") -> DataFrame:
    """Gated observations whose hash differs from the observation before.

    ``observations``: ``event_id, observation_id, observed_at, status, gate``. An event is read in pieces of ``grain``, a unit of
    ``date_trunc``, so that no task has all of a busy event.
    """
    rows = observations.select(
        "event_id",
        "observation_id",
        "observed_at",
        "gate",
        alert_hash(F.col("event_id"), F.col("status")).alias("alert_hash"),
        F.struct("observed_at", "observation_id").alias("_order"),
    )
    seen = with_previous(
        rows, ["event_id"], "_order", F.date_trunc(grain, "observed_at"), F.struct("alert_hash"), "_before"
    )
    changed = F.col("_before").isNull() | (F.col("_before.alert_hash") != F.col("alert_hash"))
    return seen.filter(F.col("gate") & changed).select("event_id", "observation_id", "observed_at", "alert_hash")


def sent_alerts(candidates: DataFrame, cooldown_s: int = fixed.ALERT_COOLDOWN_S) -> DataFrame:
    """Candidates that are sent when each sent alert silences its event for ``cooldown_s`` seconds.

    A candidate after a quiet cooldown is always sent; call it a head. From any sent alert the next one is the
    first candidate at least one cooldown later, which lies in the next two buckets of cooldown length or is a
    head. These links are followed by doubling, so a run of alerts takes a logarithmic number of rounds and no
    event is ever read as a whole.
    """
    width = cooldown_s * 1_000_000
    key = ["event_id", "bucket"]
    times = stage(
        candidates.select("event_id", F.unix_micros("observed_at").alias("t"))
        .distinct()
        .withColumn("bucket", F.floor(F.col("t") / width)),
        "alert-times",
    )
    edges = times.groupBy(*key).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))

    # Heads: no candidate in the cooldown before.
    last_before = edges.select("event_id", (F.col("bucket") + 1).alias("bucket"), F.col("last_t").alias("t_before"))
    previous = F.coalesce(F.lag("t").over(W.partitionBy(*key).orderBy("t")), F.col("t_before"))
    marked = (
        times.join(last_before, key, "left")
        .withColumn("previous", previous)
        .withColumn("is_head", F.coalesce(F.col("t") - F.col("previous") >= width, F.lit(True)))
    )
    marked = stage(marked.select("event_id", "bucket", "t", "is_head"), "alert-heads")

    # Links: a probe one cooldown later looks for the first candidate of its bucket from there on.
    probes = marked.select(
        "event_id", (F.col("bucket") + 1).alias("bucket"), (F.col("t") + width).alias("t"), F.col("t").alias("origin")
    )
    onward = W.partitionBy(*key).orderBy("t").rangeBetween(0, W.unboundedFollowing)
    looked = (
        marked.select("event_id", "bucket", "t", F.lit(None).cast("bigint").alias("origin"))
        .unionByName(probes)
        .withColumn("found", F.min(F.when(F.col("origin").isNull(), F.col("t"))).over(onward))
        .filter("origin IS NOT NULL")
    )
    first_after = edges.select("event_id", (F.col("bucket") - 1).alias("bucket"), "first_t")
    followers = marked.filter("NOT is_head").select("event_id", F.col("t").alias("next"))
    links = stage(
        looked.join(first_after, key, "left")
        .select("event_id", F.col("origin").alias("t"), F.coalesce("found", "first_t").alias("next"))
        .join(followers, ["event_id", "next"], "left_semi")
        .select("event_id", "t", "next"),
        "alert-links",
    )

    # After k rounds ``sent`` holds the first 2^k alerts of every run, and ``links`` leads 2^k alerts on, so
    # each round reaches alerts that are not there yet.
    sent = marked.filter("is_head").select("event_id", "t")
    while True:
        reached = sent.join(links, ["event_id", "t"]).select("event_id", F.col("next").alias("t"))
        reached = stage(reached, "alerts-reached")
        if reached.isEmpty():
            break
        sent = sent.unionByName(reached)
        hops = links.select("event_id", F.col("t").alias("next"), F.col("next").alias("after"))
        links = stage(
            links.join(hops, ["event_id", "next"]).select("event_id", "t", F.col("after").alias("next")), "alert-links"
        )
    at = candidates.withColumn("t", F.unix_micros("observed_at"))
    # Candidates of one instant count once: the lowest observation stands for them.
    return (
        at.groupBy("event_id", "t")
        .agg(F.min(F.struct("observation_id", "observed_at", "alert_hash")).alias("a"))
        .join(sent, ["event_id", "t"], "left_semi")
        .select(
            "event_id",
            "a.observation_id",
            "a.alert_hash",
            F.col("a.observed_at").alias("last_alert_at"),
            F.timestamp_micros(F.col("t") + width).alias("cooldown_until"),
        )
    )
