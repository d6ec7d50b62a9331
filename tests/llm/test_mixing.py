import hashlib
import math
from collections import defaultdict

import pytest

from storyspark.llm import mixing


def words(text):
    return len((text or "").encode().split())


def targets(sizes, weights, budget, cap):
    """Brute force: share out, cut, share out the rest again until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    got, free, left = {}, set(order), budget * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if cap * sizes[s] <= weight[s] * level}
        if not over:
            return got | {s: weight[s] * level for s in free}
        for s in over:
            got[s] = cap * sizes[s]
            left -= got[s]
        free -= over
    return got


def brute(rows, weights=(5, 2, 1), budget=1.5, cap=2.0):
    by_source = defaultdict(list)
    for i, text, source in rows:
        by_source[source].append((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -math.inf if i is None else i, words(text), i))
    goal = targets({s: sum(r[2] for r in v) for s, v in by_source.items()}, weights, budget, cap)
    out = []
    for source, docs in by_source.items():
        total, left = sum(d[2] for d in docs), math.floor(goal[source])
        taken = defaultdict(int)
        while left and total:
            for k, d in enumerate(sorted(docs)):
                took = min(d[2], left)
                taken[k] += took
                left -= took
        out += [(str(d[3]), d[2], total, round(goal[source], 6), taken[k]) for k, d in enumerate(sorted(docs))]
    return sorted(out)


ROWS = [(i, "w " * (i * 7 % 40), "abc"[i % 3] if i % 11 else None) for i in range(300)] + [(900, "big " * 3000, "a"), (901, None, "a"), (902, "", "e"), (None, "n o", "b"), (5, "w w w", "c"), (5, "w w w", "c")]


@pytest.mark.parametrize(("weights", "budget", "cap"), [((5, 2, 1), 1.5, 2.0), ((1,), 0.3, 1.0), ((100, 1), 1.9, 2.0), ((1, 1, 1), 2.0, 2.0)])
def test_equals_sharing_out_step_by_step(docs_of, weights, budget, cap):
    got = mixing.mix(docs_of(ROWS), weights, budget, cap).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == brute(ROWS, weights, budget, cap)


def test_every_piece_has_a_place_and_rows_come_by_the_first(docs_of):
    got = mixing.mix(docs_of(ROWS)).collect()
    firsts = [r.pieces[0].position if r.pieces else 2.0 for r in got]
    assert firsts == sorted(firsts)
    assert all(0 <= p.position <= 1 and 0 < p.taken <= r.size for r in got for p in r.pieces)
    assert all(sum(p.taken for p in r.pieces) == r.taken <= 2 * r.size for r in got)


def test_positions_follow_the_schedule(docs_of):
    """In a growing schedule, the words placed before time t are the integral of the weight up to t."""
    rows = [(i, "w", "a") for i in range(2000)]
    schedule = ((0.0, 1.0), (0.25, 1.0), (1.0, 4.0))
    got = mixing.mix(docs_of(rows), (1,), 1.0, 1.0, (schedule,)).collect()
    places = sorted(p.position for r in got for p in r.pieces)
    area = lambda t: t if t <= 0.25 else 0.25 + (t - 0.25) * (1 + 1 + 4 * (t - 0.25)) / 2
    for t in (0.1, 0.25, 0.5, 0.9):
        assert abs(sum(p <= t for p in places) / 2000 - area(t) / area(1)) < 0.002


def test_reruns_agree_whatever_the_partitions(docs_of):
    a, b = (sorted((str(r.doc_id), r.taken, str(r.pieces)) for r in mixing.mix(docs_of(ROWS, n)).collect()) for n in (1, 7))
    assert a == b


def test_taking(docs_of):
    docs = docs_of(ROWS)
    mixed = mixing.mix(docs)
    taken = mixing.take(docs, mixed)
    assert taken.columns == docs.columns
    rows = taken.collect()
    want = defaultdict(int)
    for r in mixed.collect():
        want[str(r.doc_id)] += r.taken
    got = defaultdict(int)
    for r in rows:
        got[str(r.doc_id)] += words(r.text)
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert len(rows) == sum(len(r.pieces) for r in mixed.collect())


def test_no_rows_and_no_words(docs_of):
    assert mixing.mix(docs_of([(1, "x")]).filter("doc_id = 2")).count() == 0
    assert [(r.size, r.target, r.taken) for r in mixing.mix(docs_of([(1, None), (2, " \n")])).collect()] == [(0, 0.0, 0)] * 2
