"""Events taken batch by batch, canonical events, and bodies of any kind."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from storyspark.operators import assign, changes, incremental, merge
from storyspark.plans.ingest import bodies_without_items, document_id
from storyspark.session import new_stage_path, stage
from storyspark.sinks import bucketed
from storyspark.sinks.bucketed import BucketTable
from storyspark.sources import feeds, html

T0 = dt.datetime(2024, 1, 1, 10, 0)
FACTS = "doc_id bigint, source_id bigint, seen_at timestamp, title string, lane string, tier int, source_domain string, evidence_score double"


def facts(spark, ids):
    return spark.createDataFrame([(i, i % 4, T0 + dt.timedelta(minutes=i), f"t{i}", "geral", i % 3 + 1, "d", 1.0) for i in ids], FACTS)


def sources(spark):
    return spark.createDataFrame([(k, k % 3 + 1, k == 1) for k in range(4)], "source_id bigint, tier int, is_official boolean")


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_taking_all_documents_at_once(spark, seed):
    rng = random.Random(seed)
    ids = list(range(1, 61))
    found = [(i, f"a{rng.randint(0, 25)}") for i in ids for _ in range(rng.randint(0, 2))] + [(i, "hot") for i in ids if i % 9 == 0]
    anchors = stage(spark.createDataFrame(found, "doc_id bigint, anchor_value string").withColumn("anchor_type", F.lit("PL")), "anchors")
    everything = stage(facts(spark, ids), "facts")
    whole = assign.assign_events(everything, anchors, keep=incremental.KEPT)
    store = incremental.EventStore(spark, new_stage_path(spark, "store"))
    cuts = [1, 13, 14, 40, 61]
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        inside = F.col("doc_id").between(low, high - 1)
        store.add(everything.filter(inside), anchors.filter(inside), sources(spark), k)
        if k == 2:  # a batch that is repeated changes nothing
            store.add(everything.filter(inside), anchors.filter(inside), sources(spark), k)
    got = {(r.doc_id, r.event_id, r.is_primary) for r in store.event_docs().collect()}
    assert got == {(r.doc_id, r.event_id, r.is_primary) for r in whole.collect()}
    events = {r.event_id: r for r in store.events().collect()}
    for r in assign.build_events(whole).collect():
        assert (events[r.event_id].summary, events[r.event_id].last_seen_at) == (r.summary, r.last_seen_at)
    assert {r.event_id for r in store.scores().collect()} == set(events)


def test_a_batch_returns_scores_of_touched_events_only(spark):
    anchors = spark.createDataFrame([(1, "x", "PL"), (2, "y", "PL"), (3, "x", "PL")], "doc_id bigint, anchor_value string, anchor_type string")
    store = incremental.EventStore(spark, new_stage_path(spark, "store"))
    store.add(facts(spark, [1, 2]), anchors.filter("doc_id < 3"), sources(spark), 0)
    scored = store.add(facts(spark, [3]), anchors.filter("doc_id = 3"), sources(spark), 1)
    assert [(r.event_id, r.source_count) for r in scored.collect()] == [(1, 2)]
    empty = store.add(facts(spark, [9]).filter("doc_id = 0"), anchors.filter("doc_id = 0"), sources(spark), 2, F.lit(T0))
    assert empty.count() == 0


def test_members_follow_redirects(spark):
    members = spark.createDataFrame([(1, 1, True), (2, 2, True), (2, 5, False)], "event_id bigint, doc_id bigint, is_primary boolean")
    redirects = spark.createDataFrame([(2, 1)], "from_event_id bigint, to_event_id bigint")
    moved = sorted(map(tuple, merge.follow_redirects(members, redirects).collect()))
    assert moved == [(1, 1, True), (1, 2, False), (1, 5, False)]


def test_a_merge_that_moves_on_is_reported(spark):
    columns = "event_id bigint, canonical_event_id bigint, status string, summary string, lane string, breaking_score double"
    old = spark.createDataFrame([(1, 2, "MERGED", "s", "l", 1.0)], columns)
    new = spark.createDataFrame([(1, 3, "MERGED", "s", "l", 1.0)], columns)
    assert [tuple(r) for r in changes.change_feed(old, new).collect()] == [(1, "EVENT_MERGED", "MERGED", 3)]
    assert changes.change_feed(old, old).count() == 0


RSS = "<?xml version='1.0'?>\n<rss><channel><title>x</title><item><title>a</title><link>l</link><summary>s</summary></item></channel></rss>"
ATOM = "<?xml version='1.0'?><!-- c -->\n<feed><entry><title>b</title><link href=\"h\"/><summary>t</summary></entry></feed>"


def test_feed_bodies_of_both_kinds_and_of_neither(spark):
    rows = spark.createDataFrame([(1, 7, RSS), (2, 7, ATOM), (3, 7, "<html>no</html>"), (4, 7, None), (5, 8, "<html>page</html>")], "fetch_id bigint, source_id bigint, body string")
    items = {r.fetch_id: r.i for r in rows.select("fetch_id", feeds.feed_items(F.col("body")).alias("i")).collect()}
    assert [(i.title, i.url, i.text) for i in items[1]] == [("a", "l", "s")]
    assert [(i.title, i.url, i.text) for i in items[2]] == [("b", "h", "t")]
    profiles = spark.createDataFrame([(7, "RSS"), (8, "HTML")], "id bigint, strategy string")
    assert sorted(r.fetch_id for r in bodies_without_items(rows, profiles).collect()) == [3, 4]


def test_document_ids_never_run_into_the_next_fetch(spark):
    frame = spark.createDataFrame([(5, 2**24 - 1), (6, 0)], "f bigint, i bigint")
    low, high = (r[0] for r in frame.select(document_id(F.col("f"), F.col("i"))).collect())
    assert low < high
    with pytest.raises(Exception, match="too many items"):
        frame.select(document_id(F.col("f"), F.col("i") + 2**24)).collect()


LONG = {
    "line tags": ("<br>" * 200_000 + "end", "end"),
    "open blocks": ("<nav>" * 150_000 + "text", "text"),
    "open articles": ("<article>" * 100_000 + "text", "text"),
    "brackets": ("<" * 1_000_000 + "text", None),
    "references": ("&" * 500_000 + "x", None),
    "spaces": ("a" + " \n" * 300_000 + "b", "a\nb"),
    "comments": ("<!--" * 200_000 + "-->text", "text"),
    "cells": ("<td>x</td>\n" * 50_000, None),
}


@pytest.mark.parametrize("name", LONG)
def test_odd_pages_of_a_megabyte(spark, name):
    body, want = LONG[name]
    rows = html.with_main_text(spark.createDataFrame([(1, body)], "page_id bigint, html string")).collect()
    assert len(rows) == 1 and (want is None or rows[0].text == want)


def test_all_articles_count(spark):
    page = "<article>one</article><div>no</div><article class='x'>two</article>"
    assert html.with_main_text(spark.createDataFrame([(page,)], "html string")).first().text == "one\ntwo"
    assert html.with_main_text(spark.createDataFrame([("<main>a</main>x<main>b</main>",)], "html string")).first().text == "a\nb"


def test_context_of_ten_thousand_matches(spark):
    from storyspark.functions import anchors as A

    text = " ".join(f"PL {k}/2024 e" for k in range(10_000))
    found = spark.createDataFrame([(text,)], "t string").select(F.size(A.anchor_array_with_context(F.col("t"))).alias("n")).first()
    assert found.n >= 10_000


# --- bucketed tables ---


def table(spark, n_buckets=16):
    return BucketTable(spark, new_stage_path(spark, "buckets"), "k bigint, v string", "k", n_buckets)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k int, v string, other int") if rows and len(rows[0]) == 3 else spark.createDataFrame([(*r, 0) for r in rows], "k int, v string, other int")


def test_upsert_rewrites_the_buckets_it_touches_and_no_other(spark):
    stored = table(spark)
    stored.upsert(rows_of(spark, [(k, "old") for k in range(200)]), 0)
    before = dict(stored.live())
    touched = stored.upsert(rows_of(spark, [(3, "new"), (500, "first")]), 1)
    after = dict(stored.live())
    assert len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == set(touched)
    got = {r.k: r.v for r in stored.read().collect()}
    assert got == {**{k: "old" for k in range(200)}, 3: "new", 500: "first"}
    # The batch again, and an empty one.
    assert stored.upsert(rows_of(spark, [(3, "new"), (500, "first")]), 1) == touched
    assert {r.k: r.v for r in stored.read().collect()} == got
    assert stored.upsert(rows_of(spark, [(1, "x")]).filter("k > 9"), 2) == [] and stored.read().count() == 201
    assert stored.read(before=1).filter("v = 'old'").count() == 200
    assert stored.read([stored.buckets_of(rows_of(spark, [(3, "")]))[0]], 2).filter("k = 3").collect()[0].v == "new"
    assert table(spark).read().count() == 0


def test_bytes_read_follow_the_touched_buckets_over_thirty_batches(spark):
    stored, opened = table(spark, 32), []
    for batch in range(30):
        stored.append(rows_of(spark, [(batch % 3, f"b{batch}"), (1000 + batch, "own")]), batch)
        stored.read(stored.buckets_of(rows_of(spark, [(batch % 3, "")])))
        opened.append(len(stored.opened))
    assert max(opened) <= bucketed.FAN and sum(opened[-10:]) <= 10 * bucketed.FAN
    whole = stored.read()
    assert whole.count() == 60 and whole.filter("k < 3").count() == 30
    # Folders of one bucket, not of the whole table, which has many times as many.
    assert len(stored.opened) > 3 * max(opened)
