"""Streams equal their batch forms, also over several micro-batches and replays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from storyspark.operators import alerts, evidence, health, states
from storyspark.operators.changes import change_log
from storyspark.operators.hotkeys import with_next
from storyspark.plans import adapters as ad
from storyspark.plans import catalog
from storyspark.plans.catalog import _state_log
from storyspark.session import new_stage_path, stage
from storyspark.sinks.tables import append_tables
from storyspark.streaming import ingest, runner, timers, windows

STATES = ad.STATES.replace("event_id, ts", "event_id, user_id, ts")


@pytest.fixture(scope="module")
def split_events(spark, sf_dir, tmp_path_factory):
    """The events table as four files in time order, read one per micro-batch."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = ad.table(spark, sf_dir, "events").orderBy("ts", "event_id")
    cuts = F.ntile(4).over(__import__("pyspark").sql.Window.orderBy("ts", "event_id"))
    numbered = stage(rows.withColumn("part", cuts), "numbered")
    for part in range(1, 5):
        numbered.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder, sql):
    session = runner.stream_session(spark)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    rows = runner.read_files(session, folder, "*.parquet", files_per_batch=1)
    return session.sql(sql.replace("{k}", "get_json_object(props, '$.k')"), events=rows)


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_timeouts_over_several_batches(spark, sf_dir, split_events):
    got = timers.state_timeouts(_state_log(stream(spark, split_events, STATES)), spark, new_stage_path(spark, "timeouts"))
    rows = _state_log(ad.events_view(spark, sf_dir, STATES))
    log = with_next(rows, ["event_id"], "at", F.date_trunc("hour", "at"), F.struct("at"), "following").withColumn(
        "next_at", F.col("following.at")
    )
    as_of = ad.latest(rows, "at") - F.expr("INTERVAL 1 HOUR")
    want = states.timed_transitions(log, as_of)
    columns = "event_id", "old_status", "status", "at"
    assert collected(got, *columns) == collected(want, *columns)
    assert got.count() > 100


def test_a_state_of_the_last_hour_is_neither_judged_nor_does_it_end_another(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "QUARANTINE", 0), (1, "HOT", 200), (2, "HYDRATING", 10), (3, "QUARANTINE", 130), (4, "QUARANTINE", 110), (4, "HOT", 121), (5, "HOT", 180), (6, "QUARANTINE", 100)]
    log = spark.createDataFrame([(e, s, "FAST_POOL", t0 + dt.timedelta(minutes=m)) for e, s, m in rows], "event_id bigint, status string, pool string, at timestamp")
    following = with_next(log, ["event_id"], "at", F.date_trunc("hour", "at"), F.struct("at"), "following").withColumn("next_at", F.col("following.at"))
    columns = "event_id", "old_status", "status", "at"
    # The newest row is of minute 200, so the horizon is minute 140.
    want = collected(states.timed_transitions(following, F.lit(t0 + dt.timedelta(minutes=140))), *columns)
    assert [(r[0], r[3]) for r in want] == [(1, t0 + dt.timedelta(minutes=15)), (2, t0 + dt.timedelta(minutes=11)), (6, t0 + dt.timedelta(minutes=115))]
    folder = new_stage_path(spark, "late-states")
    minute = (F.unix_timestamp("at") - int(t0.replace(tzinfo=dt.timezone.utc).timestamp())) / 60
    for low, high in ((0, 110), (110, 150), (150, 999)):  # one file after the other, in order of time
        log.filter((minute >= low) & (minute < high)).coalesce(1).write.mode("append").parquet(folder)
    live = runner.read_files(runner.stream_session(spark), folder, "*.parquet", files_per_batch=1)
    assert collected(timers.state_timeouts(live, spark, new_stage_path(spark, "timeouts")), *columns) == want


def test_alerts_over_several_batches(spark, sf_dir, split_events):
    got = timers.sent_alerts(stream(spark, split_events, ad.OBSERVATIONS), spark, new_stage_path(spark, "alerts"), 3600, late_by_s=0)
    candidates = stage(alerts.alert_transitions(ad.events_view(spark, sf_dir, ad.OBSERVATIONS)), "candidates")
    want = alerts.sent_alerts(candidates, 3600)
    columns = "event_id", "observation_id", "alert_hash", "last_alert_at", "cooldown_until"
    assert collected(got, *columns) == collected(want, *columns)
    assert got.count() > 50


def test_starvation_over_several_batches(spark, sf_dir, split_events):
    got = runner.run_available(windows.yield_starvation(stream(spark, split_events, ad.FETCHES)), spark, "starving")
    rows = ad.events_view(spark, sf_dir, ad.FETCHES)
    closed = F.col("window_start") + F.expr("INTERVAL 25 HOURS") <= ad.latest(rows, "attempted_at")
    want = health.yield_starvation(rows).filter(closed)
    columns = "source_id", "window_start", "attempts"
    assert collected(got, *columns) == collected(want, *columns)
    assert got.count() > 0


def test_velocity_over_several_batches(spark, sf_dir, split_events):
    sql = "SELECT user_id % 5 AS event_id, ts AS seen_at FROM {events}"
    got = runner.run_available(windows.event_velocity(stream(spark, split_events, sql)), spark, "velocity")
    rows = spark.sql(sql, events=ad.table(spark, sf_dir, "events"))
    slid = rows.groupBy("event_id", F.window("seen_at", "30 minutes", "1 minute")).agg(F.count("*").alias("velocity"))
    want = slid.select("event_id", "window.start", "window.end", "velocity").filter(
        F.col("end") + F.expr("INTERVAL 1 HOUR") <= ad.latest(rows, "seen_at")
    )
    columns = "event_id", "start", "velocity"
    assert collected(got, *columns) == collected(want, *columns)


def test_first_fetches(spark, split_events):
    sql = "SELECT event_type AS body, ts AS fetched_at FROM {events}"
    rows = windows.first_fetches(stream(spark, split_events, sql), late_by="60 days")
    got = runner.run_available(rows, spark, "fetches")
    assert got.count() == 5


def documents(spark, folder):
    session = runner.stream_session(spark)
    docs = runner.read_files(session, folder, "*.parquet", files_per_batch=1)
    return docs.select(
        "doc_id",
        F.concat("text", F.lit(" PL "), F.col("doc_id") % 5, F.lit("/2024")).alias("clean_text"),
        F.lit("").alias("url"),
        F.lit(True).alias("is_official"),
        F.lit(1).alias("source_id"),
        F.lit("src1").alias("source_key"),
        F.lit("src1.example.org").alias("source_domain"),
        F.lit(1).alias("tier"),
        F.lit("").alias("title"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("seen_at"),
    )


def test_ingest_goes_on_after_a_restart_and_equals_one_batch(spark, sf_dir, tmp_path):
    """Files in two starts of the stream, one per batch, against the same documents taken at once."""
    sources = spark.createDataFrame([(1, 1, True)], "source_id bigint, tier int, is_official boolean")
    docs = ad.table(spark, sf_dir, "documents")
    source, folder = str(tmp_path / "docs"), new_stage_path(spark, "tables")
    for low, high in ((0, 60), (60, 90)):
        docs.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high)).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_documents(documents(spark, source), sources, spark, folder)
    docs.filter("doc_id >= 90").coalesce(1).write.mode("append").parquet(source)
    store = ingest.ingest_documents(documents(spark, source), sources, spark, folder)
    batch = spark.read.parquet(f"{folder}/documents")
    assert sorted(r.doc_id for r in batch.collect()) == sorted(r.doc_id for r in docs.collect())
    assert batch.select("batch_id").distinct().count() == 3
    features = spark.read.parquet(f"{folder}/doc_evidence_features")
    columns = "doc_id", "evidence_score", "anchors_count"
    assert collected(features, *columns) == collected(evidence.evidence_features(batch), *columns)
    anchors = spark.read.parquet(f"{folder}/doc_anchors")
    assert anchors.filter("NOT contains(evidence_ptr, anchor_value)").isEmpty()
    assert {(r.doc_id, r.event_id) for r in store.event_docs().collect()} == {(r.doc_id, r.doc_id % 5) for r in docs.collect()}
    assert collected(store.scores(), "event_id", "source_count") == [(k, docs.filter(f"doc_id % 5 = {k}").count()) for k in range(5)]
    append_tables({"doc_anchors": anchors.drop("batch_id").limit(3)}, folder, 0)
    assert spark.read.parquet(f"{folder}/doc_anchors").filter("batch_id = 0").count() == 3


def at(minute):
    return dt.datetime(2024, 1, 1, minute // 60, minute % 60)


def states_in_files(spark, folder, files):
    for rows in files:
        spark.createDataFrame([(1, s, "FAST_POOL", at(m)) for m, s in rows], "event_id bigint, status string, pool string, at timestamp").coalesce(1).write.mode("append").parquet(folder)
    return runner.read_files(runner.stream_session(spark), folder, "*.parquet", files_per_batch=1)


def test_a_late_row_does_not_replace_a_newer_state(spark, tmp_path):
    rows = states_in_files(spark, str(tmp_path / "s"), [[(10, "HYDRATING")], [(9, "HOT")], [(300, "HOT")]])
    got = timers.state_timeouts(rows, spark, new_stage_path(spark, "timeouts"))
    assert [(r.old_status, r.status, r.at) for r in got.collect()] == [("HYDRATING", "PARTIAL_ENRICH", at(11))]


def test_rows_before_the_horizon_are_dropped_and_a_restart_goes_on(spark, tmp_path):
    source, folder = str(tmp_path / "s"), new_stage_path(spark, "timeouts")
    rows = states_in_files(spark, source, [[(10, "HYDRATING")], [(200, "NEW")], [(20, "HYDRATING")]])
    assert timers.state_timeouts(rows, spark, folder).count() == 1
    rows = states_in_files(spark, source, [[(150, "QUARANTINE")], [(400, "NEW")]])
    got = timers.state_timeouts(rows, spark, folder)
    assert collected(got, "status", "at") == [("EXPIRED", at(165)), ("PARTIAL_ENRICH", at(11))]


def test_change_log_does_not_depend_on_batches(spark, sf_dir, split_events):
    sql = """SELECT user_id % 20 AS event_id, CASE event_type WHEN 'view' THEN 7L END AS canonical_event_id,
      CASE event_type WHEN 'view' THEN 'MERGED' ELSE event_type END AS status, 's' AS summary,
      CASE WHEN event_id % 3 = 0 THEN 'geral' END AS lane, value AS breaking_score, ts AS updated_at FROM {events}"""
    got = timers.event_changes(stream(spark, split_events, sql), spark, new_stage_path(spark, "changes"), late_by_s=0)
    rows = spark.sql(sql, events=ad.table(spark, sf_dir, "events"))
    want = change_log(rows, rows.limit(0))
    columns = "event_id", "change", "status", "target_event_id"
    assert sorted(map(repr, collected_any(got, columns))) == sorted(map(repr, collected_any(want, columns)))
    assert {r.change for r in want.collect()} == {"EVENT_UPSERT", "EVENT_STATE_CHANGED", "EVENT_MERGED"}


def collected_any(df, columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("name", ["stream_first_fetches", "stream_ingest", "stream_events"])
def test_table_of_several_files_streams_like_one_file(spark, tmp_path, name):
    rows = [(k, f"texto {k % 7} sobre o processo", "pt", f"src{k % 3}", 25) for k in range(1, 41)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    (tmp_path / "folder").mkdir()
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    (tmp_path / "file").mkdir()
    docs.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    found, wanted = (sorted(map(tuple, catalog.REGISTRY[name](spark, str(tmp_path / kind)).collect())) for kind in ("folder", "file"))
    assert found == wanted and found
