"""Anchor rows and per-document evidence features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.functions import anchors as A

FEATURES = (
    "evidence_score",
    "anchors_count",
    "has_official_domain",
    "has_pdf",
    "money_count",
    "has_table_like",
)


def with_evidence(docs: DataFrame, with_context: bool = False, extra_types: bool = False) -> DataFrame:
    """Add ``anchors`` (nested) and all evidence features, in the scan that reads the text.

    A document's features depend on its own anchors only, so nothing is shuffled. ``docs`` brings ``doc_id``,
    ``clean_text``, ``is_official`` and ``url``.
    """
    build = A.anchor_array_with_context if with_context else A.anchor_array
    found = docs.withColumn("anchors", build(F.col("clean_text"), extra_types))
    weights = F.transform("anchors", lambda a: A.anchor_weight(a["anchor_type"]))
    money = F.filter("anchors", lambda a: a["anchor_type"] == "VALOR")
    return found.withColumns(
        {
            "evidence_score": A.evidence_score(F.aggregate(weights, F.lit(0.0), lambda total, w: total + w)),
            "anchors_count": F.size("anchors").cast("bigint"),
            "has_official_domain": F.coalesce(F.col("is_official"), F.lit(False)),
            "has_pdf": F.lower(F.coalesce(F.col("url"), F.lit(""))).endswith(".pdf"),
            "money_count": F.size(money).cast("bigint"),
            "has_table_like": F.lit(False),
        }
    )


def explode_anchors(docs: DataFrame) -> DataFrame:
    """Anchor rows of documents with nested ``anchors``."""
    return docs.select("doc_id", F.posexplode("anchors").alias("anchor_no", "a")).select(
        "doc_id", "anchor_no", "a.*", F.lit(1.0).alias("confidence")
    )


def extract_anchors(docs: DataFrame, with_context: bool = False, extra_types: bool = False) -> DataFrame:
    """One row per match: ``doc_id, anchor_no, anchor_type, anchor_value[, evidence_ptr], confidence``."""
    build = A.anchor_array_with_context if with_context else A.anchor_array
    return explode_anchors(docs.select("doc_id", build(F.col("clean_text"), extra_types).alias("anchors")))


def evidence_features(docs: DataFrame) -> DataFrame:
    """Score and counts for every document, also for those without anchors."""
    return with_evidence(docs).select("doc_id", *FEATURES)
