"""Ranked search against scores of all documents, one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from storyspark.llm.ranked_search import Shard, search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def split(text):
    return TERM.findall((text or "").translate(FOLD))


def expected(docs, items, k=10):
    listed = [(doc_id, Counter(split(text))) for doc_id, text in docs]
    listed = [(doc_id, tf) for doc_id, tf in listed if tf]
    n_docs, n_terms = len(listed), sum(sum(tf.values()) for _, tf in listed)
    df = Counter(t for _, tf in listed for t in tf)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, tf in listed:
            m = 25 + 75 * sum(tf.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in split(text) if t in tf)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


@pytest.fixture
def items_of(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, text string, score string")


def test_terms():
    for text in ("Ab-c9_É É\x00\x7f\u0080 naïve, x", "", " \n", "日本 Ⅷ𝟗"):
        assert [t.decode() for t in terms(text.encode())] == split(text)


@pytest.mark.parametrize("block_bytes", [8_000_000, 60])
def test_random_corpus_with_ties_and_copies(docs_of, items_of, block_bytes):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randrange(1, 40)))) for k in range(300)]
    docs += [(1000 + k, docs[7][1]) for k in range(30)] + [(2000 + k, "w1 w59 w59") for k in range(25)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 8)))) for k in range(12)] + [(50, "w1"), (51, "w59 w59 W59"), (52, "none of them")]
    assert got(search(docs_of(docs, 5), items_of(items), block_bytes=block_bytes)) == expected(docs, items)


def test_nulls_empty_texts_and_repeated_rows(docs_of, items_of):
    docs = [(1, None), (2, ""), (3, "--"), (None, "a b"), (None, "a"), (4, "a b c"), (4, "a b c"), (5, "A")]
    items = [(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, ""), (4, "a a")]
    assert got(search(docs_of(docs), items_of(items))) == expected(docs, items)


def test_empty_tables_and_a_very_long_text(docs_of, items_of):
    long = [(1, "x y " * 200_000 + "z"), (2, "z x")]
    assert got(search(docs_of(long), items_of([(1, "z y")]))) == expected(long, [(1, "z y")])
    assert got(search(docs_of(long).filter("doc_id < 0"), items_of([(1, "z")]))) == []
    assert got(search(docs_of(long), items_of([(1, "z")]).filter("item_id < 0"))) == []


def test_reading_stops_early_and_stays_exact():
    rng = np.random.default_rng(2)
    n = 5000
    docs = np.concatenate([np.arange(n), rng.choice(n, 500, replace=False)])
    places = np.repeat([0, 1], [n, 500])
    impacts = np.concatenate([rng.integers(1, 50, n), rng.integers(1000, 9000, 500)])
    shard = Shard(list(range(n)), places, docs, impacts)
    whole = np.zeros(n, np.int64)
    np.add.at(whole, docs, impacts * np.where(places == 0, 2, 1))
    kth = np.sort(whole)[-10]
    want = sorted((int(s), d) for d, s in enumerate(whole) if s >= kth)
    for first_read in (1, 64, 10_000):
        assert sorted(shard.best({0: 2, 1: 1}, 10, [], first_read)) == want
    assert shard.best({0: 1}, 10, [50] * 10) == []  # the bar of other shards leaves nobody
    assert shard.best({7: 1}, 10, []) == []
