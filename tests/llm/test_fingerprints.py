import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from storyspark.llm import fingerprints as fp

LINES = st.lists(st.text(alphabet="ab cé 日", max_size=40), min_size=1, max_size=8)


def of(text):
    return fp.vectors([text])[0]


@settings(max_examples=200, deadline=None)
@given(LINES, st.randoms())
def test_order_does_not_matter_but_content_does(lines, rng):
    mixed = list(lines)
    rng.shuffle(mixed)
    assert (of("\n".join(lines)) == of("\n".join(mixed))).all()
    changed = of("\n".join([*lines, "another line"]))
    assert not (changed[: fp.EQUAL_LANES] == of("\n".join(lines))[: fp.EQUAL_LANES]).all()


@settings(max_examples=100, deadline=None)
@given(LINES, st.text(alphabet="xyz ", min_size=1, max_size=30).filter(str.strip))
def test_insertion_and_deletion(lines, line):
    before, after = of("\n".join(lines)), of("\n".join([*lines, line]))
    assert (fp.inserted(before, line) == after).all()
    assert (fp.deleted(after, line) == before).all()


def test_neighbours_and_block_borders_do_not_matter():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdef \n", k=k)) for k in (0, 5, 70_000, 11, 12, 13, 140_000)]
    together = fp.vectors(texts)
    assert all((together[k] == of(t)).all() for k, t in enumerate(texts))
    assert not together[0].any()


def test_repeated_paragraphs_wrap_without_error():
    a, b = of("same line\n" * 70_000), of("same line")
    assert (a == (b.astype(np.uint64) * 70_000).astype(np.uint32)).all()


def test_long_repetitive_texts_stay_alike(docs_of):
    line = "a line of forty characters, repeated.  \n"
    rng = random.Random(4)
    other = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400_000))
    for text in ("x" * 100_000, line * 25_000):
        rows = [(2, text), (1, other)]
        got = {r.doc_id: r for r in fp.fingerprint_documents(docs_of(rows)).collect()}
        assert got[2].near_edited > 0.5 and got[2].near_next < 0.3


def test_64_bit_ids_are_cut_into_ranges(spark, docs_of):
    rng = random.Random(8)
    rows = [(rng.randrange(-(2**63), 2**63), f"text {k} {rng.random()}") for k in range(400)]
    ordered = fp.with_next(docs_of(rows).select("doc_id", "text"), 8)
    sizes = [r["count"] for r in ordered.filter("guest = 0").groupBy("bucket").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 150
    got = fp.fingerprint_documents(docs_of(rows), 8).collect()
    want = expected(sorted(rows, reverse=True))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == sorted(want)


def expected(rows):
    """Brute force: rows by descending id, null last, ties by the operator's order."""
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.as_text(of(text)), fp.as_text(of(edited))))
    return out


def test_documents_in_buckets(docs_of):
    rng = random.Random(5)
    rows = [(i * 3, "\n".join("".join(rng.choices("abc é", k=rng.randint(0, 60))) for _ in range(rng.randint(0, 5)))) for i in rng.sample(range(500), 120)]
    rows += [(10_000, None), (-7, "")]
    plain = sorted(((i, t or "") for i, t in rows), reverse=True)
    for buckets in (1, 2, 7, 200):
        got = fp.fingerprint_documents(docs_of(rows), buckets).collect()
        assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == sorted(expected(plain))
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_single_null_repeated_and_no_rows(spark, docs_of):
    one = fp.fingerprint_documents(docs_of([(4, "abcdef")])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1
    assert fp.fingerprint_documents(docs_of([(4, "a")]).filter("doc_id = 5")).count() == 0
    assert fp.fingerprint_documents(docs_of([(None, "x y z"), (None, None)])).count() == 2
    rows = [(1, "same"), (1, "same"), (1, "other"), (2, "two"), (None, "none"), (None, "none")]
    assert sorted(str(r.doc_id) for r in fp.fingerprint_documents(docs_of(rows), 3).collect()) == ["1", "1", "1", "2", "None", "None"]


def test_likeness_follows_what_stays():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(600)]
    text, other = " ".join(words[:300]), " ".join(words[300:])
    half = text[: len(text) // 2] + other[: len(text) // 2]
    near = fp.likeness(fp.vectors([text] * 3), fp.vectors([text, half, other]))
    assert near[0] == 1 and 0.3 < near[1] < 0.75 and near[2] < 0.3
    assert (fp.likeness(fp.vectors([""]), fp.vectors([""])) == 1).all()
