"""Fetch records, snapshots and document records of fetched bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed
from storyspark.functions.text import non_empty
from storyspark.sources.profiles import document_url


def body_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def fetch_records(fetches: DataFrame) -> DataFrame:
    """One log row per fetch: ``source_id, url, body, status_code, elapsed_s, pool, attempted_at``.

    The size counts characters and the latency is cut to whole milliseconds.
    """
    return fetches.select(
        "source_id",
        "url",
        "status_code",
        F.lit(None).cast("string").alias("error_class"),
        (F.col("elapsed_s") * 1000).cast("int").alias("latency_ms"),
        F.length("body").alias("bytes"),
        "attempted_at",
        "pool",
        body_hash(F.col("body")).alias("snapshot_hash"),
    )


def new_snapshots(fetched: DataFrame, history: DataFrame) -> DataFrame:
    """First fetch of every body not yet in ``history``: ``snapshot_hash, url, fetched_at, fetch_id``.

    Copies are combined before the shuffle, and only hashes and addresses travel, never bodies.
    """
    first = (
        fetched.withColumn("snapshot_hash", body_hash(F.col("body")))
        .groupBy("snapshot_hash")
        .agg(F.min(F.struct("fetched_at", "fetch_id", "url")).alias("f"), F.count("*").alias("copies"))
    )
    return first.join(history.select("snapshot_hash"), "snapshot_hash", "left_anti").select(
        "snapshot_hash", "f.url", "f.fetched_at", "f.fetch_id", "copies"
    )


def document_records(items: DataFrame) -> DataFrame:
    """Documents of extracted items with their whole text, and defaults for title and address.

    ``items``: ``doc_id, source_id, source_domain, endpoints, title, item_url, text, body_hash, seen_at``. ``raw_title`` is the title
    as it came, possibly empty: lanes and summaries must not read the default.
    """
    return items.select(
        "doc_id",
        "source_id",
        document_url(F.col("item_url"), F.col("endpoints")).alias("url"),
        F.coalesce(
            non_empty(F.col("title")), F.concat(F.lit(fixed.DEFAULT_TITLE_PREFIX), F.col("source_domain"))
        ).alias("title"),
        non_empty(F.col("title")).alias("raw_title"),
        F.col("text").alias("clean_text"),
        F.sha2("text", 256).alias("content_hash"),
        "body_hash",
        F.lit(1).alias("version_no"),
        "seen_at",
    )
