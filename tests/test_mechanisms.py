"""Longest suffixes, interval joins, calendars, velocity, redirects as of a time, block search, MinHash groups, merges in batches, sketches."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from storyspark import session
from storyspark.operators import calendars, deferred, hotkeys, intervals, merge, minhash, redirects, search, suffixes, velocity
from storyspark.operators.health import latency_p95
from storyspark.session import new_stage_path, stage
from storyspark.streaming import runner, sketches

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_the_longest_suffix_wins_and_only_at_a_dot(spark):
    table = spark.createDataFrame([("b.org", "short"), ("a.b.org", "long"), ("org", "top"), ("c.net", "x"), ("c.net", "y")], "suffix string, owner string")
    hosts = ["A.b.org ", "z.a.b.org", "xb.org", "b.org", "c.net", "nowhere", "", None, "notc.net"]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)] + [(99, "b.org")], "id int, host string")
    got = {r.id: r.owner for r in suffixes.longest_suffix(rows, table).collect()}
    assert got == {0: "long", 1: "long", 2: "top", 3: "short", 4: "y", 5: None, 6: None, 7: None, 8: None, 99: "short"}


def test_points_in_intervals_of_all_lengths(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.randrange(-(2**40), 2**40) if k % 2 else rng.randrange(-50, 50)) for k in range(150)]
    spans = []
    for k in range(120):
        start = rng.choice([rng.randrange(-60, 60), rng.randrange(-(2**40), 2**40)])
        spans.append((rng.choice("ab"), k, start, start + rng.choice([0, 1, 2, 7, 64, 2**20, 2**41, -3])))
    got = intervals.join_containing(
        spark.createDataFrame(points, "k string, p bigint"), spark.createDataFrame(spans, "k string, id int, s bigint, e bigint"), ["k"], "p", "s", "e"
    )
    want = sorted((k, p, i) for k, p in points for k2, i, s, e in spans if k == k2 and s <= p < e)
    assert sorted((r.k, r.p, r.id) for r in got.collect()) == want and want
    none = intervals.join_containing(spark.createDataFrame(points, "k string, p bigint"), spark.createDataFrame([], "k string, id int, s bigint, e bigint"), ["k"], "p", "s", "e")
    assert none.collect() == []


def test_calendar_baseline_compares_hours_of_one_period(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 12)], "day date")
    kinds = spark.createDataFrame([("office", 9, 18)], "calendar string, open_hour int, close_hour int")
    free = spark.createDataFrame([("office", dt.date(2024, 1, 3))], "calendar string, day date")
    periods = calendars.working_calendars(days, kinds, free)
    # The 1st is a Monday: work at 10, off at 20, the 3rd a holiday, the 6th a Saturday.
    rows = [(1, at(d * 86400 + h * 3600), y) for d, h, y in ((0, 10, 4), (0, 20, 100), (1, 11, 6), (2, 10, 50), (3, 9, 8), (5, 10, 70), (9, 17, 1))] + [(2, at(36000), 5), (2, at(39600), 7)]
    attempts = spark.createDataFrame(rows, "source_id bigint, attempted_at timestamp, yield_count int")
    sources = spark.createDataFrame([(1, "office"), (2, None)], "source_id bigint, calendar string")
    got = [(r.source_id, r.period, r.mean_yield, r.baseline_yield) for r in calendars.yield_baseline_calendar(attempts, sources, periods).orderBy("source_id", "slot").collect()]
    assert got == [
        (1, "work", 4.0, None),
        (1, "off", 100.0, None),
        (1, "work", 6.0, 4.0),
        (1, "holiday", 50.0, None),
        (1, "work", 8.0, 5.0),
        (1, "weekend", 70.0, None),
        (1, "work", 1.0, 6.0),
        (2, "none", 5.0, None),
        (2, "none", 7.0, 5.0),
    ]


@pytest.mark.parametrize("bucket_s", [1, 60, 100_000])
def test_velocity_at_arrival_counts_both_ends(spark, bucket_s):
    rng = random.Random(bucket_s)
    rows = [(k % 2, k, at(rng.choice([0, 1, 1800, 1799, 1801, 3600, rng.randrange(9000)]))) for k in range(120)] + [(0, 500, None)]
    got = {r.doc_id: r.velocity for r in velocity.velocity_at_arrival(spark.createDataFrame(rows, "event_id bigint, doc_id bigint, seen_at timestamp"), bucket_s=bucket_s).collect()}
    want = {d: sum(e2 == e and t2 is not None and t - dt.timedelta(minutes=30) <= t2 <= t for e2, _, t2 in rows) for e, d, t in rows if t}
    assert got == want


def test_redirects_as_of_follow_chains_that_change(spark):
    rng = random.Random(4)
    moves = [(f, rng.randrange(f), at(rng.randrange(100))) for f in range(1, 25) for _ in range(rng.randrange(0, 4))] + [(9, None, at(50)), (24, 23, at(0)), (23, 22, at(0))]
    asked = [(k, rng.randrange(30), at(rng.randrange(-5, 110))) for k in range(200)] + [(900, 5, None)]

    def stands(event, when):
        while when is not None:
            known = [(t, -1 if to is None else to) for f, to, t in moves if f == event and t <= when]
            if not known or max(known)[1] in (-1, event):
                break
            event = max(known)[1]
        return event

    table = spark.createDataFrame(moves, "from_event_id bigint, to_event_id bigint, valid_from timestamp")
    got = redirects.redirects_as_of(spark.createDataFrame(asked, "reader bigint, event_id bigint, at timestamp"), table).collect()
    assert {r.reader: r.target_event_id for r in got} == {k: stands(e, t) for k, e, t in asked}
    with pytest.raises(ValueError, match="ring"):
        redirects.redirect_periods(spark.createDataFrame([(1, 2, at(0)), (2, 3, at(0)), (3, 1, at(0))], "from_event_id bigint, to_event_id bigint, valid_from timestamp"))


def test_readers_of_redirects_move_once_however_many_lengths_periods_have(spark):
    table = spark.createDataFrame([(100, k, at(2**k)) for k in range(20)] + [(100, None, at(2**20))], "from_event_id bigint, to_event_id bigint, valid_from timestamp")
    asked = [(k, 100, at(s)) for k, s in enumerate(x + d for x in (2**k for k in range(21)) for d in (-0.5, 0, 0.5))] + [(99, 100, None), (98, None, at(3))]
    got = redirects.redirects_as_of(spark.createDataFrame(asked, "reader bigint, event_id bigint, at timestamp"), table)
    assert "Generate" not in got._jdf.queryExecution().toString()
    want = {k: next((e for e in reversed(range(20)) if at(2**e) <= t < at(2**20)), 100) for k, _, t in asked[:63]}
    assert {r.reader: r.target_event_id for r in got.collect()} == want | {99: 100, 98: None}


@pytest.mark.parametrize("block_docs", [7, 1000])
def test_block_search_equals_scores_of_all_documents(spark, block_docs):
    import math

    rng = random.Random(block_docs)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randrange(1, 30)))) for k in range(150)] + [(900, ""), (901, None)]
    queries = [(k, " ".join(rng.choices(words, k=4))) for k in range(10)] + [(50, "unknown"), (51, ""), (52, "w0 w0")]
    got = search.bm25_join(
        spark.createDataFrame(docs, "doc_id bigint, clean_text string"), spark.createDataFrame(queries, "query_id bigint, text string"), k=5, block_docs=block_docs
    )
    lists = {d: (t or "").split() for d, t in docs}
    mean = sum(map(len, lists.values())) / len(lists)
    df = {w: sum(w in x for x in lists.values()) for w in words}
    want = []
    for q, text in queries:
        scores = []
        for d, x in lists.items():
            s = sum(math.log(1 + (len(lists) - df[w] + 0.5) / (df[w] + 0.5)) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in text.split() if w in x)
            if s > 0:
                scores.append((-round(s, 6), d))
        want += [(q, r, d) for r, (_, d) in enumerate(sorted(scores)[:5], 1)]
    assert sorted((r.query_id, r.rank, r.doc_id) for r in got.collect()) == sorted(want)


def test_block_search_sums_scores_where_the_postings_lie(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(rng.choices("abcdefgh", k=12))) for k in range(120)] + [(None, "a b")], "doc_id bigint, clean_text string")
    queries = spark.createDataFrame([(k, " ".join(rng.choices("abcdefgh", k=3))) for k in range(6)] + [(None, "a")], "query_id bigint, text string")
    plans = []
    monkeypatch.setattr(session, "on_stage", lambda name, df: plans.append(df._jdf.queryExecution().toString()) if name == "search-first" else None)
    here, shuffled = (sorted(search.bm25_join(docs, queries, k=4, block_docs=10, sent_rows=n).collect()) for n in (1_000_000, 0))
    assert here == shuffled and len(here) == 24
    assert [bool(re.search(r"hashpartitioning\(query_id#\w+, (block#\w+, )?doc_id", p)) for p in plans] == [False, True]


def test_bands_follow_the_recall_asked_for():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99), (0.3, 0.95)):
        bands, rows = minhash.bands_for(threshold, recall, 64)
        assert bands * rows <= 64 and 1 - (1 - threshold**rows) ** bands >= recall
        assert rows == 64 or 1 - (1 - threshold ** (rows + 1)) ** (64 // (rows + 1)) < recall or rows > 1


def test_minhash_groups_reach_the_recall_and_link_nothing_else(spark):
    rng = random.Random(6)
    rows = []
    for family in range(40):
        base = [f"f{family}w{k}" for k in range(rng.randrange(10, 80))]
        for _ in range(rng.randrange(1, 6)):
            copy = [w if rng.random() > 0.06 else f"x{rng.random()}" for w in base]
            rows.append((len(rows), " ".join(copy).replace(".", "")))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, ""), (len(rows) + 2, None)]
    sets = {i: set((t or "").split()) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.group_id for r in minhash.minhash_groups(spark.createDataFrame(rows, "doc_id bigint, clean_text string")).collect()}
    assert len(got) == len(rows) and len(pairs) > 30
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[root(b)] = root(a)
    assert all(root(i) == root(g) for i, g in got.items())


def test_merges_in_batches_give_those_of_all_at_once_and_open_touched_buckets_only(spark):
    rng = random.Random(8)
    members = [(e, e * 10) for e in range(1, 41)]
    held = [(d, "PL", f"a{rng.randrange(45)}") for _, d in members for _ in range(rng.randrange(0, 3))]
    event_docs = stage(spark.createDataFrame(members, "event_id bigint, doc_id bigint"), "members")
    anchors = stage(spark.createDataFrame(held, "doc_id bigint, anchor_type string, anchor_value string"), "anchors")
    store = deferred.MergeStore(spark, new_stage_path(spark, "merges"), tolerance_s=600, n_buckets=16)
    for k in range(4):
        inside = F.col("doc_id").between(k * 100 + 1, k * 100 + 100)
        for _ in range(2 if k == 2 else 1):  # one batch is repeated
            store.add(event_docs.filter(inside), anchors.filter(inside), k, F.lit(at(k * 3600)))
    whole = merge.merge_audit(event_docs, anchors, F.lit(T0))
    want = {(r.from_event_id, r.to_event_id) for r in whole.collect()}
    assert {tuple(r) for r in store.applied(F.lit(at(3 * 3600 + 600))).collect()} == want and want
    assert store.applied(F.lit(at(599))).count() == 0
    early = {tuple(r) for r in store.applied(F.lit(at(600))).collect()}
    assert all(f <= 10 for f, _ in early)
    store.add(event_docs.filter("doc_id = 10"), anchors.filter("doc_id = 10"), 4, F.lit(at(0)))
    # One event's anchors lie in at most three of 16 buckets.
    assert len(store.index.buckets_of(anchors.filter("doc_id = 10").select(F.lit("x").alias("anchor")).distinct())) <= 1


def test_percentiles_of_a_stream_lie_within_the_error_of_the_exact_ones(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["FAST_POOL", "HEAVY_RENDER_POOL"]), at(rng.randrange(5 * 86400)), int(rng.expovariate(1 / 30_000))) for _ in range(20_000)]
    folder = new_stage_path(spark, "attempts")
    frame = spark.createDataFrame(rows, "pool string, attempted_at timestamp, latency_ms int")
    frame.repartitionByRange(4, "attempted_at").write.parquet(folder)
    live = runner.read_files(runner.stream_session(spark), folder, "*.parquet")
    stored = runner.run_available(sketches.latency_sketches(live), spark, "sketches")
    days = [r[0] for r in stored.select("window_start").distinct().collect()]
    assert len(days) == 4  # the last day is still open
    closed = frame.filter(F.date_trunc("day", "attempted_at").isin(days)).collect()
    exact = {r.pool: r for r in latency_p95(frame.filter(F.date_trunc("day", "attempted_at").isin(days))).collect()}
    for r in sketches.slo_of_sketches(stored).collect():
        values = [x.latency_ms for x in closed if x.pool == r.pool]
        assert r.attempts == len(values) == exact[r.pool].attempts
        rank = sum(v <= r.p95_ms for v in values) / len(values)
        assert abs(rank - 0.95) <= sketches.RANK_ERROR and r.is_breach == exact[r.pool].is_breach


def test_minhash_buckets_of_many_kinds_take_few_rounds(spark, monkeypatch):
    """200 sets of 50 kinds share one bucket; one representative a round took 50 rounds."""
    rows = [(4 * kind + copy, ["least", *(f"k{kind}w{w}" for w in range(12)), f"c{copy}"]) for kind in range(50) for copy in range(4)]
    sets = spark.createDataFrame([(i, sorted(t)) for i, t in rows], "set_id bigint, tokens array<string>")
    monkeypatch.setattr(minhash, "bands_for", lambda *_: (1, 1))
    monkeypatch.setattr(minhash, "signatures", lambda sets, size, f=minhash.signatures: f(sets, size).withColumn("minima", F.array(F.lit(1).cast("bigint"))))
    rounds = []
    monkeypatch.setattr(minhash, "stage", lambda df, name, f=minhash.stage: rounds.append(name) or f(df, name))
    got = {(r.u, r.v) for r in minhash.minhash_links(sets, 0.8, 0.999, 4).collect()}
    assert got >= {(4 * kind + copy, 4 * kind) for kind in range(50) for copy in (1, 2, 3)}
    assert all(u // 4 == v // 4 for u, v in got)
    assert rounds.count("minhash-links") <= 4


def one_bucket(spark, monkeypatch, rows):
    monkeypatch.setattr(minhash, "bands_for", lambda *_: (1, 1))
    monkeypatch.setattr(minhash, "signatures", lambda sets, size, f=minhash.signatures: f(sets, size).withColumn("minima", F.array(F.lit(1).cast("bigint"))))
    return spark.createDataFrame([(i, sorted(t)) for i, t in rows], "set_id bigint, tokens array<string>")


@pytest.mark.parametrize("block", [2_000, 5])
def test_minhash_links_connect_what_all_similar_pairs_of_a_bucket_connect(spark, monkeypatch, block):
    """A set that is similar to a representative was compared with none of the others: the far end of a chain was left out."""
    monkeypatch.setattr(minhash, "BUCKET_SETS", block)
    monkeypatch.setattr(minhash, "KINDS", 3)
    rng = random.Random(11)
    rows = []
    for chain in range(9):
        words = [f"c{chain}w{k}" for k in range(140)]
        rows += [set(words[10 * step : 10 * step + 100]) for step in range(5)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {(r.u, r.v) for r in minhash.minhash_links(one_bucket(spark, monkeypatch, rows), 0.8, 0.999, 4).collect()}
    like = lambda a, b: len(a & b) / len(a | b) >= 0.8
    want = {(i, j) for i, a in rows for j, b in rows if i > j and like(a, b)}
    assert len(want) == 36 and got <= want

    def groups(pairs):
        root = dict.fromkeys(range(len(rows)))
        root = {i: i for i in root}
        for _ in rows:
            for u, v in pairs:
                root[u] = root[v] = min(root[u], root[v])
        return root

    assert groups(got) == groups(want)


def test_minhash_fetches_the_tokens_of_wanted_sets_only(spark, monkeypatch):
    """Every round shuffled the tokens of all sets, twice."""
    sets = spark.createDataFrame([(i, [f"w{i}"]) for i in range(-500, 500)], "set_id bigint, tokens array<string>")
    ids = spark.createDataFrame([(i,) for i in range(-20, 20)], "set_id bigint")
    got = hotkeys.rows_among(sets, "set_id", ids)
    assert "Exchange hashpartitioning(set_id" not in got._jdf.queryExecution().toString()
    assert set(range(-20, 20)) <= {r.set_id for r in got.collect()} and got.count() < 60
    rows = [(k, {f"k{k}w{w}" for w in range(30)} | {"x"}) for k in range(40)] + [(40, {f"k0w{w}" for w in range(30)})]
    seen = []
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *rest, f=minhash._verified: seen.append(pairs.count()) or f(pairs, *rest))
    links = minhash.minhash_links(one_bucket(spark, monkeypatch, rows), 0.8, 0.999, 4).collect()
    assert [tuple(r) for r in links] == [(40, 0)] and seen[0] == 1 and sum(seen) < 10


def test_redirects_that_change_often_cost_their_periods_not_their_pairs(spark, monkeypatch):
    """Every step met all periods of its target, so events that change often met by the square of their changes."""
    rng = random.Random(12)
    moves = [(f, rng.randrange(f), at(rng.randrange(5000))) for f in range(1, 21) for _ in range(150)] + [(20, None, at(2500)), (None, 3, at(1)), (7, 3, None)]
    asked = [(k, rng.randrange(22), at(rng.randrange(-5, 5100) + 0.5)) for k in range(400)]
    by_event = {}
    for f, to, t in moves:
        if f is not None and t is not None:
            by_event.setdefault(f, {})[t] = max(f if to is None else to, by_event.get(f, {}).get(t, -1))

    def stands(event, when):
        known = [t for t in by_event.get(event, ()) if t <= when]
        to = by_event[event][max(known)] if known else event
        return event if to == event else stands(to, when)

    staged = []
    monkeypatch.setattr(session, "on_stage", lambda name, df: staged.append(df._jdf.queryExecution().optimizedPlan().toString()))
    table = spark.createDataFrame(moves, "from_event_id bigint, to_event_id bigint, valid_from timestamp")
    got = redirects.redirects_as_of(spark.createDataFrame(asked, "reader bigint, event_id bigint, at timestamp"), table).collect()
    assert {r.reader: r.target_event_id for r in got} == {k: stands(e, t) for k, e, t in asked}
    joins = [line for plan in staged for line in plan.splitlines() if "Join" in line]
    assert joins and not any(re.search(" [<>] ", line) for line in joins)
