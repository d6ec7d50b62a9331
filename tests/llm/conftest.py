import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)``, with a column that clashes with inner names."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None) for r in rows]
        frame = spark.createDataFrame(full, DOCS).repartition(partitions)
        for name in ("n", "size", "position", "terms", "tie", "root", "words", "hub", "score", "count"):
            frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame

    return make
