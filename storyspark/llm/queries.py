"""The registered query of each operator, with its production parameters, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.llm import (
    conversation_repair,
    decontamination,
    fingerprints,
    line_dedup,
    mixing,
    ngram_join,
    quality,
    ranked_search,
    revisits,
    secrets,
    token_counts,
    token_files,
    toxicity,
)
from storyspark.llm.common import bounded_labels, id_crc, read
from storyspark.session import new_stage_path, stage

#: Labelled documents from which a classifier learns, at most.
LABELLED_ROWS = 10_000
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
TOKEN_LIMIT = 1024


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each revisit among the page captures, its original and the merged headers as sorted ``name=value`` lines."""
    resolved = revisits.resolve_revisits(revisits.page_records(read(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"])))
    return resolved.select("record_id", "canonical_url", "original_id", "status", F.array_join(lines, "\n").alias("headers"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; documents whose id has crc32 mod 5 = 0 are held out from learning."""
    docs = read(spark, sf_dir, "documents")
    machine = toxicity.fit(_labelled(docs, read(spark, sf_dir, "labels"), "toxic", id_crc(F.col("doc_id")) % 5 != 0))
    return _predicted(toxicity.score(docs, machine), id_crc(F.col("doc_id")) % 5 == 0, 0.5)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(read(spark, sf_dir, "documents"), ngram_join.Rule(n=4, percent=85))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), weights=(5, 2, 1), budget=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; documents whose id has crc32 mod 4 = 2 are held out from learning."""
    docs = read(spark, sf_dir, "documents")
    ranking = quality.fit(_labelled(docs, read(spark, sf_dir, "labels"), "quality", id_crc(F.col("doc_id")) % 4 != 2), cut_score=0.7)
    return _predicted(quality.score(docs, ranking), id_crc(F.col("doc_id")) % 4 == 2, 0.7)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_stage_path(spark, "token-files")
    token_files.write_token_files(read(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), TOKEN_LIMIT)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every damaged conversation, and the digest of the repaired one."""
    conversations = read(spark, sf_dir, "conversations")
    rows = stage(conversation_repair.damage(conversations), "damaged-conversations")
    repairs = stage(conversation_repair.repair(rows), "conversation-repairs")
    hashed = conversation_repair.digests(conversation_repair.apply_audits(rows, repairs))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    known = repairs.select(F.struct("conv_id").alias("key"), *counts, "audit").join(hashed.select(F.struct("conv_id").alias("key"), "repaired_sha256"), "key", "left")
    every = conversations.select(F.struct("conv_id").alias("key")).distinct().join(known, "key", "left")
    return every.select(
        F.col("key.conv_id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and lines dropped of every document, and the digest of the text that is left."""
    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """Texts of a bounded sample of labelled documents; the sample's ids are few enough to send to all tasks."""
    sample = bounded_labels(labels, label, learn, LABELLED_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label")


def _predicted(scores: DataFrame, held_out: Column, cut: float) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_revisits,
        op2_toxicity,
        op3_fingerprints,
        op4_ngram_join,
        op5_mixing,
        op6_decontamination,
        op7_quality,
        op8_token_files,
        op9_token_counts,
        op10_secrets,
        op11_ranked_search,
        op12_conversation_repair,
        op13_line_dedup,
    )
}
