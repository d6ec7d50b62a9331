import random

import numpy as np
import pytest

from storyspark.llm import quality, toxicity
from storyspark.llm.common import bounded_labels, read
from storyspark.llm.queries import QUERIES


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, label int")


def test_machine_learns_a_pair_that_no_sum_of_weights_can(spark, docs_of):
    """An insult or a group name alone is fine, and so is neither; only both together are toxic."""
    rng = random.Random(1)
    filler = [f"filler{k}" for k in range(30)]
    rows = []
    for _ in range(1200):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((" ".join(rng.choices(filler, k=8) + ["vermin"] * insult + ["people"] * group), int(insult and group)))
    machine = toxicity.fit(frame(spark, rows))
    got = {r.doc_id: r.score for r in toxicity.score(docs_of([(1, "vermin people filler1"), (2, "vermin filler1"), (3, "people filler2"), (4, "filler3")]), machine).collect()}
    assert got[1] > 0.5 > max(got[2], got[3], got[4])
    pair = toxicity.FactorizationMachine(0.0, np.array([3, 8]), np.zeros(2), np.array([[2.0], [3.0]]))
    assert pair.margin([np.array([0, 1]), np.array([0]), np.array([], int)]).tolist() == [6.0, 0.0, 0.0]


def test_members_of_a_pair_without_any_effect_of_their_own_are_found(spark, docs_of):
    """Exactly one of an insult and a group name: each alone tells nothing about the label."""
    rng = random.Random(3)
    filler = [f"filler{k}" for k in range(200)]
    rows = []
    for _ in range(2000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((" ".join(rng.choices(filler, k=20) + ["vermin"] * insult + ["people"] * group), int(insult != group)))
    machine = toxicity.fit(frame(spark, rows))
    assert {t for w in ("vermin", "people") for t in toxicity.piece_terms(w)} <= set(machine.buckets.tolist())
    texts = {1: "vermin people filler1", 2: "vermin filler1", 3: "people filler2", 4: "filler3"}
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(list(texts.items())), machine).collect()}
    assert min(got[2], got[3]) > 0.5 > max(got[1], got[4])


def test_score_equals_all_pairs_of_terms(spark, docs_of):
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(12)]
    buckets = np.array(sorted({t for w in words for t in toxicity.piece_terms(w)}))
    machine = toxicity.FactorizationMachine(0.3, buckets, rng.normal(0, 0.5, len(buckets)), rng.normal(0, 0.5, (len(buckets), 3)))
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 9)))) for k in range(40)] + [(None, "word1 other"), (7, "word1"), (7, "WORD1 word1")]
    want = []
    for doc_id, text in rows:
        held = sorted({int(np.searchsorted(buckets, t)) for w in text.lower().split() for t in toxicity.piece_terms(w) if t in buckets})
        odds = 0.3
        for i, a in enumerate(held):
            odds += machine.weights[a]
            for b in held[:i]:
                odds += sum(x * y for x, y in zip(machine.factors[a], machine.factors[b], strict=True))
        want.append((str(doc_id), round(1 / (1 + np.exp(-odds)), 9)))
    got = [(str(r.doc_id), round(r.score, 9)) for r in toxicity.score(docs_of(rows), machine).collect()]
    assert sorted(got) == sorted(want)


def test_empty_tables(spark, docs_of):
    none = docs_of([(1, "a")]).filter("doc_id = 2")
    assert toxicity.score(none, toxicity.fit(frame(spark, [("a", 1), ("b", 0)]))).collect() == []
    assert quality.score(none, quality.fit(frame(spark, [("a", 1), ("b", 0)]), 0.7)).collect() == []


def test_ranking_lowers_the_loss_over_all_preference_pairs(spark):
    rng = random.Random(6)
    rows = [(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(5, 60))) + "." * (k % 3), int(k % 3 == 0)) for k in range(90)]
    ranking = quality.fit(frame(spark, rows), 0.7)
    worth = ranking.worth(np.array([quality.features(t) for t, _ in rows]))
    gaps = [worth[a] - worth[b] for a in range(90) for b in range(90) if rows[a][1] > rows[b][1]]
    assert np.mean([np.log1p(np.exp(-g)) for g in gaps]) < 0.5 * np.log(2)
    assert np.mean([g > 0 for g in gaps]) > 0.9


@pytest.mark.parametrize("rows", [[], [("a", 1)], [("a b", 0), (None, 0)]])
def test_one_class_or_none(spark, docs_of, rows):
    texts = docs_of([(1, None), (2, ""), (None, "x " * 50_000), (2, "")])
    scores = toxicity.score(texts, toxicity.fit(frame(spark, rows))).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores) and len({r.score for r in scores}) == 1
    ranks = quality.score(texts, quality.fit(frame(spark, rows), 0.7)).collect()
    assert len(ranks) == 4 and all(0 <= r.score <= 1 for r in ranks)
    assert all((r.score >= 0.7) == (not rows or rows[0][1] == 1) for r in ranks)


def test_keeping_rows_below_a_score(spark, docs_of):
    machine = toxicity.FactorizationMachine(-3.0, np.array(sorted(toxicity.piece_terms("vermin"))), np.full(3, 2.0), np.zeros((3, 1)))
    docs = docs_of([(1, "vermin"), (2, "fine"), (None, None), (3, ""), (3, "Vermin!"), (4, "x " * 90_000 + "VERMIN")])
    kept = toxicity.keep_below(docs, machine, 0.5)
    assert kept.columns == docs.columns and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "None"]
    assert toxicity.keep_below(docs.filter("doc_id = 99"), machine, 0.5).count() == 0


def test_ranking_orders_pairs_and_cuts_at_the_quantile(spark, docs_of):
    rng = random.Random(2)
    good = [(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(60)), 1) for _ in range(80)]
    bad = [(" ".join(["SPAM!!"] * 60), 0)] * 10 + [(" ".join(rng.choice(["a", "b"]) for _ in range(80)), 0) for _ in range(10)]
    ranking = quality.fit(frame(spark, good + bad), 0.7)
    again = quality.fit(frame(spark, (good + bad)[::-1]), 0.7)
    assert np.allclose(ranking.weights, again.weights) and ranking.cut == pytest.approx(again.cut)
    x = np.array([quality.features(t) for t, _ in good + bad])
    scores = ranking.score(x)
    assert scores[:80].min() >= 0.7 > scores[80:].max()


def test_features_of_odd_texts():
    for text in ("", " \n", "a", "é" * 10, "word " * 100_000, "!!!", "\x00", "😀 😀"):
        values = quality.features(text)
        assert len(values) == len(quality.FEATURES) and all(np.isfinite(values)) and min(values) >= 0


def test_labels_are_bounded_and_ties_take_the_largest(spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, None, 0), (None, 1, 1), (3, 1, None), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    from pyspark.sql import functions as F

    assert sorted((r.doc_id, r.label) for r in bounded_labels(labels, "toxic", F.lit(True), 10).collect()) == [(1, 1), (2, 0), (4, 0)]
    assert bounded_labels(labels, "toxic", F.lit(True), 2).count() == 2


@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.94), ("op7_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES[name](spark, folder).join(read(spark, folder, "labels"), "doc_id").filter("held_out").collect()
    assert len(rows) > 500
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    if label == "toxic":
        toxic = [r for r in rows if r.toxic]
        assert np.mean([r.predicted for r in toxic]) >= 0.85
