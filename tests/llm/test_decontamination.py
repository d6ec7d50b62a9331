import random
import re

import pytest

from storyspark import session
from storyspark.llm import decontamination as dc


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items):
    """The best weighted Jaccard of every window of an item's size, at every position, with that item."""
    sets = {i: shingles(words(t)) for i, t in items}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, set()).add(i)
    weight = lambda s: sum(1 / len(holders.get(x, "1")) for x in s)
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            n = len(words(item))
            if not n or not w:
                continue
            for start in range(max(1, len(w) - n + 1)):
                s = shingles(w[start : start + n])
                if s & sets[i]:
                    both = weight(s & sets[i])
                    like = both / (weight(s) + weight(sets[i]) - both)
                    if like >= 0.8:
                        out[(d, i)] = max(like, out.get((d, i), 0))
    return out


def case(seed, n_docs=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 60)))) for k in range(12)]
    items.append((50, items[0][1] + " " + word()))  # nearly the same item
    docs = []
    for d in range(n_docs):
        text = [word() for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 2)):
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2)):
                passage[rng.randrange(len(passage))] = word()
            if rng.random() < 0.2:
                del passage[rng.randrange(len(passage))]
            at = rng.randint(0, len(text))
            text[at:at] = [p.upper() + "," if rng.random() < 0.1 else p for p in passage]
        docs.append((d, " ".join(text)))
    return docs, items


def found(docs_of, spark, docs, items):
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, n_words int, weight string")
    return {(r.doc_id, r.item_id): r.similarity for r in dc.find_contamination(docs_of(docs), bench).collect()}


def test_equals_all_windows(spark, docs_of):
    for seed in (1, 2):
        docs, items = case(seed)
        got, want = found(docs_of, spark, docs, items), brute(docs, items)
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 0.02 for k in want)


def test_nulls_short_items_and_repeated_rows(spark, docs_of):
    passage = " ".join(f"word{k}" for k in range(20))
    items = [(1, passage), (1, passage), (2, None), (3, ""), (4, "two words"), (None, " ".join(f"other{k}" for k in range(15)))]
    docs = [(1, passage), (1, passage), (2, None), (3, ""), (4, "Two, words!"), (5, "not two words"), (None, passage), (6, "x " * 50_000 + passage), (7, " ".join(f"other{k}" for k in range(15)))]
    got = found(docs_of, spark, docs, items)
    assert set(got) == {(1, 1), (4, 4), (None, 1), (6, 1), (7, None)}
    assert found(docs_of, spark, [(1, "a b c d e f")], [(1, None)]) == {}


def test_empty_tables(spark, docs_of):
    docs = docs_of([(1, "a b c d e f g")])
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    assert dc.find_contamination(docs, bench.filter("item_id = 2")).count() == 0
    assert dc.find_contamination(docs.filter("doc_id = 2"), bench).count() == 0
    assert dc.find_contamination(docs, bench).count() == 1


def test_documents_without(spark, docs_of):
    docs, items = case(3, 30)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = docs_of([*docs, (None, "kept")])
    kept = dc.without_contamination(frame, bench)
    bad = {d for d, _ in brute(docs, items)}
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*(str(d) for d, _ in docs if d not in bad), "None"])


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        a = rng.getrandbits(64)
        flips = rng.sample(range(64), rng.randint(0, 20))
        b = a
        for f in flips:
            b ^= 1 << f
        rows.append((k, a - 2**63, b - 2**63))
    frame = spark.createDataFrame(rows, "k bigint, a bigint, b bigint")
    shared = frame.select("k", dc._blocks(frame["a"], 20).alias("x"), dc._blocks(frame["b"], 20).alias("y")).selectExpr("k", "size(array_intersect(x, y)) AS n")
    assert shared.filter("n = 0").count() == 0


def test_plan_has_no_python_and_no_cross_join(spark, docs_of):
    docs, items = case(5, 5)
    plan = dc.find_contamination(docs_of(docs), spark.createDataFrame(items, "item_id bigint, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def moved(seed, n_docs=40):
    """Documents with passages of which blocks or sentences have changed places."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(k, " ".join(word() for _ in range(rng.randint(40, 70)))) for k in range(8)]
    items.append((50, " ".join([*items[0][1].split()[:-1], word()])))  # nearly the same item
    docs = []
    for d in range(n_docs):
        passage = rng.choice(items)[1].split()
        cuts = sorted(rng.sample(range(1, len(passage)), rng.randint(1, 2)))
        blocks = [passage[a:b] for a, b in zip([0, *cuts], [*cuts, len(passage)], strict=True)]
        rng.shuffle(blocks)
        text = [word() for _ in range(rng.randint(0, 120))]
        at = rng.randint(0, len(text))
        text[at:at] = [w for b in blocks for w in b]
        docs.append((d, " ".join(text)))
    return docs, items


def test_halves_that_changed_places_are_found(spark, docs_of):
    item = [f"w{k}" for k in range(50)]
    before, after = [f"b{k}" for k in range(80)], [f"a{k}" for k in range(80)]
    text = " ".join([*before, *item[25:], *item[:25], *after])
    got = found(docs_of, spark, [(1, text), (2, " ".join(before + after))], [(7, " ".join(item))])
    assert got == {(1, 7): 0.84}


def test_equals_all_windows_with_moved_blocks(spark, docs_of):
    for seed in (6, 7):
        docs, items = moved(seed)
        got, want = found(docs_of, spark, docs, items), brute(docs, items)
        assert set(got) == set(want) and len(want) > 10
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_best_window_of_every_planted_passage(spark, docs_of):
    docs, items = case(1)
    got, want = found(docs_of, spark, docs, items), brute(docs, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("limit", [dc.BROADCAST_ROWS, 0])
def test_rows_stay_small_and_a_window_s_rows_lie_together(spark, docs_of, monkeypatch, limit):
    """Every hit carried the words of its whole text, and windows lay scattered by shingle once weights were too many for Spark's own broadcast."""
    monkeypatch.setattr(dc, "BROADCAST_ROWS", limit)
    staged = {}
    monkeypatch.setattr(session, "on_stage", lambda name, df: staged.setdefault(name, df._jdf.queryExecution().executedPlan().toString()))
    docs, items = case(9, 20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = found(docs_of, spark, docs, items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(got) == set(brute(docs, items))
    narrow = [line for line in staged["bench-hits"].splitlines() if "hashpartitioning" in line]
    assert narrow and "bench-blocks" not in staged
    joined = staged["bench-shingles"]
    assert "SortMergeJoin" not in joined if limit else re.search(r"Exchange hashpartitioning\(n_words#\w+, window_id#\w+", joined)
