"""The registered queries against their SQL, their columns and the pipeline against its parts."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from check import compare, connect
from storyspark.llm.common import may_hold, id_filter, read
from storyspark.llm.oracle import LLM_ORACLE
from storyspark.llm.queries import QUERIES

COLUMNS = {
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op4_ngram_join": "doc_id n_shingles component_id",
    "op5_mixing": "doc_id size source_size target taken",
    "op7_quality": "doc_id held_out score predicted",
    "op8_token_files": "doc_id start n_tokens ids_crc32",
    "op9_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op13_line_dedup": "doc_id n_lines n_dropped kept_sha256",
}


def test_all_and_the_pipeline_are_registered():
    names = contract.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(LLM_ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", LLM_ORACLE)
def test_query_equals_sql(spark, sf_dir, name):
    ok, note = compare(QUERIES[name](spark, sf_dir), connect(sf_dir), LLM_ORACLE[name])
    assert ok, note


@pytest.mark.parametrize("name", COLUMNS)
def test_one_row_per_document_and_the_columns_asked_for(spark, sf_dir, name):
    result = contract.queries()[name](spark, sf_dir)
    assert result.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    documents = read(spark, sf_dir, "documents")
    assert sorted(r.doc_id for r in result.select("doc_id").collect()) == sorted(r.doc_id for r in documents.select("doc_id").collect())


def test_pipeline_stages(spark, sf_dir):
    docs = documents = read(spark, sf_dir, "documents")
    sizes = [documents.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, sf_dir), name)
        assert docs.columns == documents.columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(last) == sizes[4]
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, last))


def test_id_filter(spark):
    held = id_filter(spark.range(0, 5000, 5))
    ids = spark.range(0, 5000).toPandas()["id"].to_numpy()
    passed = may_hold(held.value, ids)
    assert passed[ids % 5 == 0].all() and passed[ids % 5 != 0].sum() < 50


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    """Null ids and texts, empty and very long texts, repeated rows and columns with names that stages use."""
    long = " ".join(f"word{k}" for k in range(40_000)) + "."
    rows = [(10**6, None), (10**6 + 1, ""), (None, "a text without any id at all"), (10**6 + 2, long), (10**6 + 3, "twice the same row"), (10**6 + 3, "twice the same row"), (10**6 + 4, " \n\t")]
    odd = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    documents = read(spark, sf_dir, "documents")
    docs = documents.unionByName(odd.select(*(odd[c].cast(documents.schema[c].dataType) for c in documents.columns)))
    for name in ("score", "terms", "n", "root", "words", "target", "size", "place", "position", "part"):
        docs = docs.selectExpr("*", f"'x' AS {name}")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.stage(step(spark, docs, sf_dir), name)
        assert docs.columns == columns
    kept = {(r.doc_id, (r.text or "")[:20]): r for r in docs.filter(f"doc_id is null or doc_id >= {10**6}").collect()}
    assert {i for i, _ in kept} == {None, *range(10**6, 10**6 + 5)} and len(kept) == 6
    assert kept[10**6 + 2, long[:20]].text == long and kept[10**6, ""].text is None
    mixed = corpus_pipeline.stage(corpus_pipeline.STAGES[3][1](spark, docs, sf_dir), "mixing")
    assert mixed.columns == columns
    tokens = corpus_pipeline.STAGES[4][1](spark, mixed, sf_dir).collect()
    assert len(tokens) == mixed.count() and all(r.n_tokens >= 1 for r in tokens)
    empty = documents.limit(0)
    for name, step in corpus_pipeline.STAGES[:-1]:
        empty = corpus_pipeline.stage(step(spark, empty, sf_dir), name)
        assert empty.columns == documents.columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0
