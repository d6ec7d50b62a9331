import random

import pytest

from storyspark.llm import ngram_join as nj


def sets_of(rows, n):
    out = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        out.append(frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset())
    return out


def brute(rows, n, percent):
    """``(doc_id, n_shingles, component_id)`` by comparing all pairs."""
    sets = sets_of(rows, n)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    lowest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            lowest[find(k)] = min(i, lowest.get(find(k), i))
    return sorted(((i, len(sets[k]), lowest.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def joined(docs, n, percent, counters=2**16, hot_list=nj.HOT_LIST):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.join_components(docs, nj.Rule(n, percent), counters, hot_list).collect()), key=str)


def corpus(seed, families=6, size=12, passage=True):
    """Families of edited copies, a passage that many share, exact copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=4))
    common = [word() for _ in range(30)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            if passage and rng.random() < 0.5:
                copy = copy + common
            rows.append(" ".join(copy))
    rows += ["One two", "one  two\n", "one two three four", "ONE TWO THREE FOUR", "", None, " \t\n", "x"]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60), (4, 3, 95)])
def test_equals_all_pairs(docs_of, seed, n, percent):
    rows = corpus(seed)
    assert joined(docs_of(rows), n, percent) == brute(rows, n, percent)


def test_order_of_elements_does_not_change_results(docs_of):
    rows = corpus(7)
    assert joined(docs_of(rows), 4, 85, counters=2**10) == brute(rows, 4, 85)


@pytest.mark.parametrize("hot_list", [1, 3, 20])
def test_long_lists_dealt_by_sets_give_the_same(docs_of, hot_list):
    rows = corpus(9) + [(5000 + k, " ".join(["copied"] * 3 + [f"c{j}" for j in range(60)])) for k in range(25)]
    assert joined(docs_of(rows, 6), 4, 85, hot_list=hot_list) == brute(rows, 4, 85)


def test_one_large_family_and_minor_members(docs_of):
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(80)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(80)] = f"w{i}{rng.random()}"
        rows.append((i, " ".join(copy)))
    assert joined(docs_of(rows), 4, 85) == brute(rows, 4, 85)


def test_null_ids_repeated_ids_and_clashing_columns(docs_of):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(None, long), (8, long), (8, long), (None, "alone here"), (None, None), (5, long + " more"), (3, "different text of one id"), (3, long)]
    assert joined(docs_of(rows), 4, 85) == brute(rows, 4, 85)


def test_empty_table_and_very_long_text(docs_of):
    assert joined(docs_of([(1, "x")]).filter("doc_id = 2"), 4, 85) == []
    rng = random.Random(2)
    words = [str(rng.random()) for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-50])), (3, " ".join(words[30_000:]))]
    assert joined(docs_of(rows), 4, 85) == brute(rows, 4, 85)


def test_one_of_each(docs_of):
    rows = corpus(5)
    docs = docs_of(rows)
    kept = nj.one_of_each(docs, nj.Rule(5, 80), 2**16)
    want = [i for i, n, c in brute(rows, 5, 80) if c == i or n == 0]
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_one_of_each_with_64_bit_and_null_ids_in_one_batch(docs_of):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(2**62 + k, f"{long} {'x' * (k % 3)}") for k in range(20)] + [(None, f"own text {k}") for k in range(20)] + [(2**53 + 2 * k + 1, f"other {k} text") for k in range(20)]
    kept = nj.one_of_each(docs_of(rows, 1), nj.Rule(5, 80), 2**16).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted([2**62] + [2**53 + 2 * k + 1 for k in range(20)])
    assert sum(r.doc_id is None for r in kept) == 20


def test_one_of_each_with_repeated_rows_and_null_ids(docs_of):
    rows = [(4, "a b c d e f g"), (4, "a b c d e f g"), (9, "a b c d e f g"), (None, "a b c d e f g"), (None, "q r s"), (1, ""), (2, None)]
    kept = nj.one_of_each(docs_of(rows), nj.Rule(5, 80), 2**16).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept if r.doc_id is not None) == [("1", ""), ("2", ""), ("4", "a b c d e f g")]
    assert nj.one_of_each(docs_of(rows).filter("doc_id = 77"), nj.Rule(5, 80), 2**16).count() == 0
