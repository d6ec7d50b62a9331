"""Line deduplication against a plain count over lists of lines."""

import random

import pytest

from storyspark.llm.line_dedup import dedup_lines, line_facts, repeated_lines

A, B, C = "A line that is long enough", "another line, also long enough", "ç" * 20


def expected(rows, min_chars=20, min_docs=3):
    def key(line):
        return line.strip(" \t\x0b\f\r").translate({i: i + 32 for i in range(65, 91)})

    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        keep = []
        for line in lines:
            ids = holders.get(key(line), ())
            largest = max(ids, key=lambda i: float("-inf") if i is None else i) if ids else None
            if len(ids) < min_docs or doc_id == largest:
                keep.append(line)
        out.append((doc_id, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def got(docs, **options):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(docs, **options).collect()), key=str)


def test_lines_of_three_documents_stay_in_the_last_only(docs_of):
    rows = [(1, f"{A}\nshort"), (2, f"  {A.upper()}\t\r\n{B}"), (3, f"{B}\n{A}\n{A}"), (4, "short")]
    assert got(docs_of(rows)) == expected(rows)
    assert [r[1] for r in expected(rows)] == ["short", B, f"{B}\n{A}\n{A}", "short"]


def test_nulls_empty_texts_repeated_rows_and_ids(docs_of):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, A), (None, f"{A}\nx"), (5, A), (5, A), (5, f"{A}\n{B}"), (6, f"{C}\n{A}"), (7, C), (8, f"{C}x"), (9, C), (9, C)]
    assert got(docs_of(rows)) == expected(rows)


def test_code_points_decide_the_length_and_only_ascii_is_folded(docs_of):
    rows = [(k, "É" * 19 + " ") for k in range(4)] + [(k, "É" * 20) for k in range(10, 13)] + [(k, "é" * 20) for k in range(20, 22)]
    assert got(docs_of(rows)) == expected(rows)


def test_a_long_text_and_a_line_in_every_document(docs_of):
    rng = random.Random(3)
    pool = [f"sentence number {k} of the common pool" for k in range(40)]
    rows = [(k, "\n".join([A, *(rng.choice(pool) for _ in range(rng.randrange(6))), f"own line of document number {k}"])) for k in range(120)]
    rows.append((500, "\n".join([A, *(f"line {k} of a very long document" for k in range(60_000)), *pool * 200])))
    assert got(docs_of(rows)) == expected(rows)


def test_other_limits_and_columns(docs_of):
    rows = [(1, "aa\nbb"), (2, "aa\ncc"), (3, "dd")]
    assert got(docs_of(rows), min_chars=2, min_docs=2) == expected(rows, 2, 2)
    docs = docs_of(rows).selectExpr("*", "'x' AS key", "'y' AS dropped", "'z' AS n_lines", "1 AS _lines_")
    result = dedup_lines(docs)
    assert result.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert {r.key for r in result.collect()} == {"x"}


@pytest.mark.parametrize("hot", [True, False])
def test_counts_are_of_documents_not_lines(docs_of, hot):
    rows = [(k // 5, A) for k in range(50 if hot else 10)]
    found = repeated_lines(line_facts(docs_of(rows), 20), 1).collect()
    assert [(r.n_docs, r.n_lines) for r in found] == [(10, 50) if hot else (2, 10)]


def test_empty_table(docs_of):
    assert got(docs_of([(1, A)]).filter("doc_id < 0")) == []
