"""Set operators against small hand-made and brute-force results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from storyspark import session
from storyspark.operators import alerts, assign, changes, feed, graph, health, hotkeys, merge, neardup, scoring, similar, versions
from storyspark.session import stage
from storyspark.sinks import tables

T0 = dt.datetime(2024, 1, 1)


def doc_tables(spark, held, minutes=None):
    """Documents and anchors from ``{doc_id: [anchor values]}``."""
    docs = [(d, 1, T0 + dt.timedelta(minutes=(minutes or {}).get(d, d))) for d in held]
    anchors = [(d, "PL", v) for d, vs in held.items() for v in vs]
    return (
        spark.createDataFrame(docs, "doc_id bigint, source_id int, seen_at timestamp"),
        spark.createDataFrame(anchors, "doc_id bigint, anchor_type string, anchor_value string"),
    )


def one_by_one(held, seen=None, lookback=None):
    """Documents taken in order, each joining the event of the lowest earlier document it shares an anchor with."""
    event = {}
    for d in sorted(held):
        earlier = [
            e
            for e in event
            if set(held[e]) & set(held[d]) and (lookback is None or 0 <= seen[d] - seen[e] <= lookback)
        ]
        event[d] = event[min(earlier)] if earlier else d
    return event


@pytest.mark.parametrize("hot_rows", [1, 2, 10**9])
def test_bridge_document_does_not_merge(spark, hot_rows):
    docs, anchors = doc_tables(spark, {1: ["x"], 2: ["y"], 3: ["x", "y"], 4: ["y"], 5: []})
    rows = assign.assign_events(docs, anchors, hot_rows=hot_rows).collect()
    assert {r.doc_id: r.event_id for r in rows} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}
    assert {r.doc_id for r in rows if r.is_primary} == {1, 2, 5}


@pytest.mark.parametrize("seed", [1, 2])
def test_assignment_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    held = {d: [f"a{rng.randint(d // 4, d // 4 + 12)}" for _ in range(rng.randint(0, 3))] for d in range(120)}
    for d in range(0, 120, 3):
        held[d].append("hot" if d > 60 else f"b{d}")
    docs, anchors = doc_tables(spark, held)
    anchors = stage(anchors, "anchors")
    got = {r.doc_id: r.event_id for r in assign.assign_events(docs, anchors, hot_rows=5).collect()}
    assert got == one_by_one(held)
    # Roots are their own event, and assigning again changes nothing.
    assert all(got[e] == e and e <= d for d, e in got.items())
    seen = {d: d for d in held}
    got = assign.assign_events(docs, anchors, lookback_seconds=20 * 60).collect()
    assert {r.doc_id: r.event_id for r in got} == one_by_one(held, seen, 20)


@pytest.mark.parametrize("hot_rows", [1, 3, 10**9])
def test_roots_and_components(spark, hot_rows):
    rng = random.Random(hot_rows)
    parent = {i: (i if i == 0 or rng.random() < 0.05 else rng.randint(max(0, i - 4), i - 1)) for i in range(300)}
    df = stage(spark.createDataFrame(list(parent.items()), "id bigint, parent bigint"), "forest")

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    got = {r.id: r.root for r in graph.resolve_roots(df, hot_rows).collect()}
    assert got == {i: root(i) for i in parent}

    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(200, x) for x in range(201, 230)]
    label = {}
    for u, v in edges:
        label.setdefault(u, u), label.setdefault(v, v)
    for _ in range(200):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    got = graph.connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), hot_rows).collect()
    looped = {u for u, v in edges if u == v} - {x for u, v in edges if u != v for x in (u, v)}
    assert {r.id: r.root for r in got} == {k: v for k, v in label.items() if k not in looped}
    assert len(got) == len({r.id for r in got})


def test_merge_and_redirects(spark):
    held = {1: ["x"], 2: ["y"], 3: ["x", "y"], 4: ["y"], 5: []}
    docs, anchors = doc_tables(spark, held)
    event_docs = stage(assign.assign_events(docs, anchors), "event-docs")
    audit = merge.merge_audit(event_docs, anchors, F.lit(T0), hot_rows=2).collect()
    assert [(r.from_event_id, r.to_event_id) for r in audit] == [(2, 1)]
    chain = spark.createDataFrame([(9, 8), (8, 7), (7, 3), (5, 4)], "from_event_id bigint, to_event_id bigint")
    got = {r.from_event_id: r.to_event_id for r in merge.resolve_redirects(chain).collect()}
    assert got == {9: 3, 8: 3, 7: 3, 5: 4}


def test_previous_and_next_equal_lag_and_lead(spark):
    rng = random.Random(3)
    rows = [(k, n, rng.random()) for k in range(4) for n in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "k int, n int, x double")
    chunk = F.floor(F.col("n") / 7)
    before = hotkeys.with_previous(df, ["k"], "n", chunk, F.struct("x"), "p")
    after = hotkeys.with_next(before, ["k"], "n", chunk, F.struct("x"), "f")
    got = {(r.k, r.n): (r.p and r.p.x, r.f and r.f.x) for r in after.collect()}
    for (k, n, _), prev, nxt in zip(rows, [None, *rows[:-1]], [*rows[1:], None]):
        want = (prev[2] if prev and prev[0] == k else None, nxt[2] if nxt and nxt[0] == k else None)
        assert got[(k, n)] == want


@pytest.mark.parametrize("max_bucket", [1, 3, 10**6])
def test_near_duplicates_equal_brute_force(spark, max_bucket):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    hashes = {c for c in centres}
    for c in centres:
        for _ in range(15):
            h = c
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                h ^= 1 << bit
            hashes.add(h)
    signed = [h - (1 << 64) if h >> 63 else h for h in sorted(hashes)]
    rows = [(i, h, 5) for i, h in enumerate(signed)] + [(1000 + i, h, 5) for i, h in enumerate(signed[:10])]
    df = spark.createDataFrame(rows, "doc_id bigint, simhash bigint, token_count bigint")
    for distance in (1, 3):
        got = neardup.near_duplicate_pairs(df, distance, max_bucket).collect()
        want = {
            (i, j)
            for i in range(len(signed))
            for j in range(i + 1, len(signed))
            if bin((signed[i] ^ signed[j]) & (2**64 - 1)).count("1") <= distance
        }
        assert {(r.doc_a, r.doc_b) for r in got} == want and len(got) == len(want)
    assert {r.copies_a for r in got if r.doc_a < 10} == {2}


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 1.0])
def test_similar_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        base = rng.sample(range(60), rng.randint(1, 14))
        for _ in range(3):
            words = [w for w in base if rng.random() > 0.15] + rng.sample(range(60, 400), rng.randint(0, 2))
            texts.append(" ".join(f"w{w}" for w in words))
    texts += texts[:8] + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, clean_text string")
    got = {(r.doc_a, r.doc_b): r.jaccard for r in similar.similar_pairs(docs, threshold, hot_rows=20).collect()}
    first = {}
    for i, t in enumerate(texts):
        if t:
            first.setdefault(frozenset(t.split()), i)
    sets = sorted((i, s) for s, i in first.items())
    want = {}
    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            score = len(a & b) / len(a | b)
            if score >= threshold:
                want[(i, j)] = pytest.approx(score)
    assert got == want


def test_similar_pairs_of_sets_of_all_sizes_compare_few_tokens(spark, monkeypatch):
    """Sets larger than the bits of a short signature, sharing rare tokens and common words: hardly a pair but the similar ones gets as far as its tokens."""
    rng = random.Random(3)
    texts, want = [], set()
    for k in range(24):
        size = (40, 700, 2300)[k % 3]
        words = [f"w{w}" for w in rng.sample(range(20_000), size)] + [f"rare{k // 6}"]
        texts += [" ".join(words), " ".join(words[: size * 9 // 10])]
        want.add((2 * k, 2 * k + 1))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, clean_text string")
    compared = []
    monkeypatch.setattr(session, "on_stage", lambda name, df: compared.append(df.count()) if name == "likely-pairs" else None)
    for levels in (similar.LEVELS, ((30, 16), (800, 16), (2**31 - 1, 64))):
        found = similar.similar_pairs(docs, 0.6, levels=levels).collect()
        assert {(r.doc_a, r.doc_b) for r in found} == want and len(found) == len(want)
    assert compared[0] == len(want)


def test_cooldown_equals_fold(spark):
    rng = random.Random(11)
    rows, number = [], 0
    for event in range(5):
        at = 0.0
        for _ in range(80):
            at += rng.choice([1, 20, 100, 299, 300, 301, 900]) + rng.random()
            rows.append((event, number, T0 + dt.timedelta(seconds=at), f"h{number}"))
            number += 1
    rows.append((0, number, rows[0][2], "same instant"))
    df = spark.createDataFrame(rows, "event_id bigint, observation_id bigint, observed_at timestamp, alert_hash string")
    got = {r.observation_id for r in alerts.sent_alerts(stage(df, "candidates"), 300).collect()}
    want, until = set(), {}
    for event, n, at, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if at >= until.get(event, T0):
            want.add(n)
            until[event] = at + dt.timedelta(seconds=300)
    assert got == want


def test_alert_needs_transition_and_gate(spark):
    rows = [
        (1, 1, T0, "NEW", True),
        (1, 2, T0 + dt.timedelta(days=1), "NEW", True),
        (1, 3, T0 + dt.timedelta(days=2), "HOT", False),
        (1, 4, T0 + dt.timedelta(days=2, hours=1), "HOT", True),
        (1, 5, T0 + dt.timedelta(days=9), "NEW", True),
    ]
    df = spark.createDataFrame(rows, "event_id bigint, observation_id bigint, observed_at timestamp, status string, gate boolean")
    assert {r.observation_id for r in alerts.alert_transitions(df).collect()} == {1, 5}


def story(spark):
    events = spark.createDataFrame(
        [(1, None, "HOT", "a", "geral", 85.0, T0, T0, T0), (2, None, "NEW", "b", "", 50.0, T0, T0, T0), (3, None, "IGNORED", "", None, 90.0, T0, T0, T0)],
        "event_id bigint, canonical_event_id bigint, status string, summary string, lane string, breaking_score double, "
        "first_seen_at timestamp, last_seen_at timestamp, created_at timestamp",
    )
    event_docs = spark.createDataFrame(
        [(1, 1, 1, T0, True), (1, 2, 9, T0 + dt.timedelta(hours=1), False)],
        "event_id bigint, doc_id bigint, source_id int, seen_at timestamp, is_primary boolean",
    )
    return events, event_docs


def test_scores_of_unknown_sources_and_empty_events(spark):
    events, event_docs = story(spark)
    sources = spark.createDataFrame([(1, 2, True)], "source_id int, tier int, is_official boolean")
    event_docs = event_docs.withColumn("evidence_score", F.when(F.col("doc_id") == 1, F.lit(4.0)))
    as_of = F.lit(T0 + dt.timedelta(hours=1, minutes=30))
    got = {r.event_id: r for r in scoring.score_events(events, event_docs, sources, as_of).collect()}
    assert (got[1].source_count, got[1].velocity, got[1].max_evidence) == (1, 1, 4.0)
    assert got[1].gap_score == 36.0
    assert (got[2].source_count, got[2].velocity, got[2].gap_score) == (0, 0, 15.0)
    assert set(got) == {1, 2, 3}


def test_feed_has_one_row_per_event_and_a_table_of_all_anchors(spark):
    events, event_docs = story(spark)
    anchors = spark.createDataFrame(
        [(1 + n % 2, "PL", f"PL {n % 50}") for n in range(120)], "doc_id bigint, anchor_type string, anchor_value string"
    )
    rows = feed.event_feed(events, event_docs, anchors, limit=2).collect()
    assert [(r.event_id, r.anchor_count, r.mentions) for r in rows] == [(3, 0, 0), (1, 50, 120)]
    every = feed.feed_anchors(events, event_docs, anchors, limit=2).collect()
    assert len(every) == 50 and sum(r.mentions for r in every) == 120
    assert feed.event_feed(events, event_docs, anchors, status="NEW").select("event_id").collect()[0][0] == 2
    assert feed.event_feed(events, event_docs, anchors, lane="nada").count() == 0
    cards = {r.event_id: r for r in feed.dashboard_cards(events, event_docs, anchors).collect()}
    assert set(cards) == {1, 2}
    assert cards[1].tags == ["PL: PL 0", "PL: PL 1", "PL: PL 10"] and cards[1].score_label == "85%"
    assert cards[2].lane == "geral" and cards[2].tags == []


def test_feed_lists_all_anchors_of_an_event_in_pages(spark):
    events, event_docs = story(spark)
    anchors = spark.createDataFrame([(1 + n % 2, "PL", f"PL {n % 1500}") for n in range(3000)] + [(1, "CPF", "x")], "doc_id bigint, anchor_type string, anchor_value string")
    rows = [r for r in feed.event_feed(events, event_docs, anchors).collect() if r.event_id == 1]
    assert {(r.anchor_count, r.mentions) for r in rows} == {(1501, 3001)} and [r.anchor_page for r in rows] == [0, 1]
    listed = [(a.type, a.value, a.mentions) for r in rows for a in r.anchors]
    assert sorted(listed) == sorted([("PL", f"PL {n}", 2) for n in range(1500)] + [("CPF", "x", 1)])


def test_change_feed(spark):
    columns = "event_id bigint, canonical_event_id bigint, status string, summary string, lane string, breaking_score double"
    old = spark.createDataFrame([(1, None, "NEW", "a", "x", 1.0), (2, None, "NEW", "a", "x", 1.0), (3, None, "NEW", "a", None, 1.0), (4, None, "NEW", "a", "x", 1.0)], columns)
    new = spark.createDataFrame(
        [
            (1, None, "HOT", "a", "x", 2.0),
            (2, 1, "MERGED", "a", "x", 1.0),
            (3, None, "NEW", "a", None, 1.0),
            (4, None, "NEW", "b", "x", 1.0),
            (5, None, "NEW", "a", "x", 1.0),
        ],
        columns,
    )
    got = {r.event_id: (r.change, r.target_event_id) for r in changes.change_feed(old, new).collect()}
    assert got == {1: ("EVENT_STATE_CHANGED", None), 2: ("EVENT_MERGED", 1), 4: ("EVENT_UPSERT", None), 5: ("EVENT_UPSERT", None)}


def test_version_gaps(spark):
    rows = [("u", 1, ["a"], 1.0, T0), ("u", 5, ["a", "b"], 1.0, T0), ("u", 2000, ["b"], None, None), ("v", 1, [], None, None)]
    df = spark.createDataFrame(rows, "url string, version_no int, anchors array<string>, value double, time timestamp")
    got = {(r.from_version, r.to_version): r for r in versions.full_deltas(df).collect()}
    assert set(got) == {(1, 5), (5, 2000)}
    assert got[(1, 5)].anchors.added == ["b"] and got[(1, 5)]["values"] is None
    assert got[(5, 2000)].anchors.removed == ["a"] and got[(5, 2000)]["values"].diff == -1.0


def test_starvation_window_per_source(spark):
    rows = [(1, T0 + dt.timedelta(hours=h), 200, 0, 24) for h in range(3)] + [
        (2, T0, 200, 0, 1),
        (2, T0 + dt.timedelta(hours=1), 200, 5, 1),
        (3, T0, 500, 0, 24),
    ]
    df = spark.createDataFrame(rows, "source_id bigint, attempted_at timestamp, status_code int, yield_count int, hours int")
    got = {(r.source_id, r.window_start, r.attempts) for r in health.yield_starvation(df, F.col("hours")).collect()}
    assert got == {(1, T0, 3), (2, T0, 1)}


def test_upsert_keeps_latest(spark):
    columns = "event_id bigint, breaking_score double, computed_at timestamp"
    later = T0 + dt.timedelta(hours=1)
    stored = spark.createDataFrame([(1, 1.0, T0), (2, 2.0, T0)], columns)
    incoming = spark.createDataFrame([(1, 5.0, T0), (1, 6.0, later), (3, 3.0, T0)], columns)
    got = {r.event_id: r.breaking_score for r in tables.upsert_scores(stored, incoming).collect()}
    assert got == {1: 6.0, 2: 2.0, 3: 3.0}


def test_drafts_and_feedback(spark):
    rows = [(1, "t", 0.69), (2, None, 0.7), (3, "t", None)]
    df = spark.createDataFrame(rows, "event_id bigint, title string, confidence double").selectExpr(
        "*", "'body' AS clean_text", "array('s') AS sources", "array('PL 1') AS anchors", "CAST(NULL AS DOUBLE) AS evidence_score",
        "array('R') AS reasons", "array('t') AS timeline",
    )
    got = {r.event_id: r.draft_json for r in tables.draft_articles(df, F.lit(T0)).collect()}
    assert '"needs_review":true' in got[1] and "review" not in got[2] and "review" not in got[3]
    assert '"status":"DRAFT"' in got[1] and '"evidence_score":0.0' in got[1]
    feedback = spark.createDataFrame(
        [(1, "IGNORE", '{"user_id":"u"}'), (2, "publish", "{}"), (3, "MERGE", "{}"), (4, None, None)],
        "event_id bigint, action string, payload_json string",
    )
    got = {r.event_id: (r.actor, r.is_valid) for r in tables.check_feedback(feedback).collect()}
    assert got == {1: ("u", True), 2: ("anonymous", False), 3: ("anonymous", True), 4: ("anonymous", False)}
    events, _ = story(spark)
    got = {r.event_id: r.status for r in tables.apply_feedback(events, feedback).collect()}
    assert got == {1: "IGNORED", 2: "NEW", 3: "IGNORED"}


@pytest.mark.parametrize("hot_rows", [1, 3, 10**9])
def test_tfidf(spark, hot_rows):
    texts = ["a a b", "a c", "a d d d", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, clean_text string")
    got = {(r.doc_id, r["rank"]): (r.term, r.tf, r.df) for r in similar.tfidf_top_terms(docs, 1, hot_rows=hot_rows).collect()}
    assert got == {(0, 1): ("b", 1, 1), (1, 1): ("c", 1, 1), (2, 1): ("d", 3, 1)}


def test_tfidf_counts_terms_where_the_text_lies(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(session, "on_stage", lambda name, df: plans.setdefault(name, df._jdf.queryExecution().toString()))
    rows = [(1, "a a b"), (1, "b c"), (2, "a"), (None, "a d"), (None, "d"), (3, None)]
    got = similar.tfidf_top_terms(spark.createDataFrame(rows, "doc_id bigint, clean_text string"), 1).collect()
    assert {(r.doc_id, r.term, r.tf, r.df) for r in got} == {(1, "b", 2, 1), (2, "a", 1, 3), (None, "d", 2, 1)}
    assert "hashpartitioning(doc_id" in plans["term-counts"] and plans["term-counts"].count("Exchange") == 1


def test_minhash_estimates_jaccard(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:360]), " ".join(reversed(words)) + " w1", "other words", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, clean_text string")
    signatures = {r.doc_id: r.minhash for r in similar.minhash_signatures(docs).collect()}
    assert set(signatures) == {0, 1, 2, 3} and signatures[0] == signatures[2]
    pairs = spark.createDataFrame([(signatures[0], signatures[i]) for i in (0, 1, 3)], "a array<bigint>, b array<bigint>")
    same, close, far = [r[0] for r in pairs.select(similar.minhash_similarity(F.col("a"), F.col("b"))).collect()]
    assert same == 1.0 and close >= 0.5 and far <= 0.25


def test_bm25_prefers_rare_terms(spark):
    texts = ["lei senado", "lei lei", "nada", "senado", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, clean_text string")
    got = [r.doc_id for r in similar.bm25_top(docs, ["senado", "lei"], limit=10).collect()]
    assert got[0] == 0 and set(got) == {0, 1, 3}
