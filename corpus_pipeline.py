"""A training corpus from raw documents in five stages, each a Spark job over all that the one before kept.

1. Toxicity: documents that a factorization machine rejects go.
2. Near-duplicates: of documents connected by similar five-word n-gram sets, the one with the smallest id stays.
3. Benchmark decontamination: documents with a passage of a benchmark item go.
4. Mixing: every source comes near its target weight; documents are repeated, left out or cut, in curriculum order.
5. Token files: what is left is written as flat token files, and one row per document is read back from them.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``.

Odd rows. A null text is empty: it scores as the machine's bias, duplicates and contaminates nothing, has no words to mix and one token, the end id. A null id
stays null; rows without id are near-duplicates of others like any row, and are written first. Of repeated rows of one id one stays, rows of one id with different texts
are documents of their own. Very long texts are read whole, in time and memory in proportion to their length. Further columns, whatever their names, go through all stages
but the last. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.llm import decontamination, mixing, ngram_join, token_files, toxicity
from storyspark.llm.common import bounded_labels, read, small_batches
from storyspark.llm.queries import END_ID, LABELLED_ROWS, TOKENIZER
from storyspark.session import new_stage_path, stage

#: The order of operations can't be written as one SQL query: learned models, fingerprints and token files are among them.
ORACLE_SQL = None
TOXIC = 0.5
NEAR_DUPLICATE = ngram_join.Rule(n=5, percent=80)
Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(step: Step) -> Step:
    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return step(spark, docs, sf_dir)

    return run_step


@bounded
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = bounded_labels(read(spark, sf_dir, "labels"), "toxic", F.lit(True), LABELLED_ROWS)
    machine = toxicity.fit(docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("text", "label"))
    return toxicity.keep_below(docs, machine, TOXIC)


@bounded
def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, NEAR_DUPLICATE)


@bounded
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contamination(docs, read(spark, sf_dir, "benchmark"))


@bounded
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, mixing.mix(docs))


@bounded
def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = new_stage_path(spark, "pipeline-tokens")
    token_files.write_token_files(docs, folder, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read_token_files(spark, folder)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of the token files: ``doc_id, part, start, n_tokens, ids_crc32``."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
