"""From fetched bodies to document records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.sources.feeds import feed_items
from storyspark.sources.fetches import body_hash, document_records, new_snapshots
from storyspark.sources.html import with_main_text

# Document ids grow with the fetch and leave room for this many items of one body, far more than the bytes of a body
# allow. A body with more stops the job instead of taking ids of the next fetch.
ITEMS_PER_FETCH = 2**24


def document_id(fetch_id: Column, item_no: Column) -> Column:
    too_many = F.raise_error(F.concat(F.lit("too many items in fetch "), fetch_id.cast("string"))).cast("bigint")
    return F.when(item_no < ITEMS_PER_FETCH, fetch_id * ITEMS_PER_FETCH + item_no).otherwise(too_many)


def documents_from_fetches(
    fetched: DataFrame, profiles: DataFrame, history: DataFrame | None = None, skip_known: bool = True
) -> DataFrame:
    """Document records of feed items and page texts.

    ``fetched``: ``fetch_id, source_id, url, body, fetched_at``; ``profiles``: active profiles. With
    ``skip_known`` a body counts once, at its first fetch, and not at all when ``history`` (``snapshot_hash``)
    holds it; without it every fetch brings its items again. Feeds and pages are read in one pass: each body
    goes through the extraction of its source's strategy only.
    """
    rows = fetched
    if skip_known:
        known = fetched.limit(0).select(F.lit("").alias("snapshot_hash")) if history is None else history
        rows = rows.join(new_snapshots(fetched, known).select("fetch_id"), "fetch_id", "left_semi")
    source = profiles.select(F.col("id").alias("source_id"), "source_domain", "strategy", "endpoints")
    is_feed = F.col("strategy") == "RSS"
    bodies = rows.join(source, "source_id").select(
        "fetch_id",
        "source_id",
        "source_domain",
        "endpoints",
        F.col("fetched_at").alias("seen_at"),
        body_hash(F.col("body")).alias("body_hash"),
        feed_items(F.when(is_feed, F.col("body"))).alias("feed_items"),
        F.when(~is_feed, F.col("body")).alias("html"),
    )
    nothing = F.lit(None).cast("string")
    page = F.array(F.struct(nothing.alias("title"), nothing.alias("url"), F.col("text").alias("text")))
    pages = F.when(F.col("text") != "", page)
    items = with_main_text(bodies).select(
        "fetch_id",
        "source_id",
        "source_domain",
        "endpoints",
        "seen_at",
        "body_hash",
        F.posexplode(F.coalesce("feed_items", pages)).alias("item_no", "item"),
    )
    return document_records(
        items.select(
            document_id(F.col("fetch_id"), F.col("item_no")).alias("doc_id"),
            "source_id",
            "source_domain",
            "endpoints",
            "item.title",
            F.col("item.url").alias("item_url"),
            "item.text",
            "body_hash",
            "seen_at",
        )
    )


def bodies_without_items(fetched: DataFrame, profiles: DataFrame) -> DataFrame:
    """``fetch_id, source_id, body_hash`` of feed bodies that give no item: empty feeds, other formats and broken markup."""
    source = profiles.select(F.col("id").alias("source_id"), "strategy").filter("strategy = 'RSS'")
    items = feed_items(F.col("body"))
    parsed = fetched.join(source, "source_id").select("fetch_id", "source_id", body_hash(F.col("body")).alias("body_hash"), F.size(items).alias("items"))
    return parsed.filter("items IS NULL OR items < 1").drop("items")


def story_documents(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """What the main path asks of documents, from their records and the profiles of their sources.

    The title is the raw one: an untitled document has none, and its event is named after its domain.
    """
    source = profiles.select(F.col("id").alias("source_id"), "source_key", "source_domain", "tier", "is_official")
    titled = records.withColumn("title", F.coalesce("raw_title", F.lit(""))).drop("raw_title")
    return titled.join(source, "source_id").select(
        "doc_id", "source_id", "source_key", "source_domain", "tier", "is_official", "title", "url", "clean_text", "seen_at"
    )
