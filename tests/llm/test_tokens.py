"""Operators 8 and 9 against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from storyspark.llm import token_counts, token_files
from storyspark.session import new_stage_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = [
    "the", "word", "Thing", "naïve", "don't", "we'll've", "x", "3", "3.14", "1,000", ".", ",", "...", "a.b", "_", "é", "ñandú", "日本語", "½", "Ⅷ", "é",
    " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "\x02", "\x03", "😀", "<|endoftext|>", "<|endof", "'s", "'", "\"", "-", "(x)", "\x00",
]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=60)


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return token_files._Encoder(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(PATH)


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_ids_by_piece_equal_those_of_the_whole_text(encoder, text):
    assert encoder.by_piece
    assert np.frombuffer(encoder.ids(text), encoder.kind).tolist() == expected(text)


@settings(max_examples=1500, deadline=None)
@given(TEXTS)
def test_counts_equal_those_of_the_library(counter, text):
    assert counter.count(text) == len(expected(text))


def test_merging_takes_the_lowest_rank_first():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2, ("a", "a"): 3}
    assert token_counts.merge_count(list("abc"), ranks) == 2
    assert token_counts.merge_count(list("aaa"), ranks) == 1  # the leftmost pair, once
    assert token_counts.merge_count(["a"], ranks) == token_counts.merge_count([], ranks) == 0


def test_kept_answers_are_bounded():
    answers = token_counts.Answers(len, 10)
    assert [answers[str(k)] for k in range(35)] == [len(str(k)) for k in range(35)]
    assert len(answers) <= 10


ROWS = [(5, "one two"), (None, "no id"), (2, None), (2, "tie"), (2, "tie"), (9, ""), (7, "long word. " * 30_000), (-3, "Ünïcode,\nline\n"), (None, "")]


def test_files_round_trip(spark, docs_of):
    folder = new_stage_path(spark, "tokens")
    manifest = token_files.write_token_files(docs_of(ROWS), folder, PATH, end_id=2, n_parts=4)
    rows = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i))
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    want = sorted((-1 if i is None else i, len(expected(t)) + 1, zlib.crc32(np.array([*expected(t), 2], "<u4").tobytes())) for i, t in ROWS)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)
    assert sorted(w[1:] for w in want) == sorted(g[1:] for g in got)
    last = manifest.orderBy("part").collect()
    assert sum(m.n_docs for m in last) == len(ROWS) and all(m.width == 2 for m in last)
    assert last[-1].base_tokens + last[-1].n_tokens == sum(w[1] for w in want)


def test_flat_file_holds_all_ids_in_order(spark, docs_of):
    folder = new_stage_path(spark, "tokens")
    rows = [(i, f"text number {i}") for i in range(200)]
    random.Random(1).shuffle(rows)
    manifest = token_files.write_token_files(docs_of(rows), folder, PATH, end_id=2, n_parts=3).orderBy("part").collect()
    flat = np.concatenate([np.fromfile(f"{folder}/{token_files._name(m.part)}.tokens", "<u2") for m in manifest])
    assert flat.tolist() == [x for i in range(200) for x in [*expected(f"text number {i}"), 2]]


def test_empty_tables(spark, docs_of):
    folder = new_stage_path(spark, "tokens")
    none = docs_of([(1, "x")]).filter("doc_id = 2")
    token_files.write_token_files(none, folder, PATH, end_id=2)
    assert token_files.read_token_files(spark, folder).count() == 0
    assert token_counts.count_tokens(none, PATH, 10).count() == 0


def test_counts_of_rows(docs_of):
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs_of(ROWS), PATH, 1024).collect())
    want = sorted((len((t or "").encode()), len(expected(t)), len(expected(t)) > 1024) for _, t in ROWS)
    assert got == want


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_a_vocabulary_that_joins_words_is_encoded_whole():
    encoder = token_files._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not encoder.by_piece
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("Some Text,  here", add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids("Some Text,  here"), encoder.kind).tolist() == whole


def test_64_bit_ids_are_spread_over_parts(spark, docs_of):
    rng = random.Random(6)
    rows = sorted((rng.randrange(-(2**63) + 1, 2**63), f"text {k}") for k in range(300))
    folder = new_stage_path(spark, "wide-ids")
    manifest = token_files.write_token_files(docs_of(rows), folder, PATH, end_id=2, n_parts=4).collect()
    assert len(manifest) >= 6 and max(r.n_docs for r in manifest) < 120
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == [i for i, _ in rows]
