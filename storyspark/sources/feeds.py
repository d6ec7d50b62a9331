"""RSS and Atom feeds: one row per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark import schemas
from storyspark.functions.text import non_empty

ITEM_FILE_SCHEMA = "title string, link string, description string, summary string"


def item_text(summary: Column, description: Column) -> Column:
    return F.coalesce(non_empty(summary), non_empty(description), F.lit(""))


def is_atom(body: Column) -> Column:
    """The root element is an Atom ``feed``, after an XML declaration and one comment at most."""
    return body.rlike(r"(?i)^\s*(?:<\?xml[^>]*>\s*)?(?:<!--[^>]*-->\s*)?<(?:atom:)?feed\b")


def _atom_entries(body: Column) -> Column:
    return F.transform(
        F.from_xml(body, schemas.ATOM_BODY)["entry"],
        lambda entry: F.struct(
            entry["title"].alias("title"),
            entry["link"]["_href"].alias("url"),
            item_text(entry["summary"], F.lit(None).cast("string")).alias("text"),
        ),
    )


def _rss_channel_items(body: Column) -> Column:
    return F.transform(
        F.from_xml(body, schemas.RSS_BODY)["channel"]["item"],
        lambda item: F.struct(
            item["title"].alias("title"),
            item["link"].alias("url"),
            item_text(item["summary"], item["description"]).alias("text"),
        ),
    )


def feed_items(body: Column) -> Column:
    """Items of an RSS or Atom body as ``array<struct<title, url, text>>``; null for a null body and one without items."""
    return F.when(is_atom(body), _atom_entries(body)).otherwise(_rss_channel_items(body))


def rss_items(feeds: DataFrame) -> DataFrame:
    """Items of RSS bodies: ``feeds`` columns without the body, plus ``item_no, title, url, text``."""
    keep = [c for c in feeds.columns if c != "body"]
    items = feeds.select(*keep, F.posexplode(feed_items(F.col("body"))).alias("item_no", "item"))
    return items.select(*keep, "item_no", "item.*")


def atom_items(feeds: DataFrame) -> DataFrame:
    """Entries of Atom bodies, in the shape of :func:`rss_items`."""
    keep = [c for c in feeds.columns if c != "body"]
    entries = feeds.select(*keep, F.posexplode(_atom_entries(F.col("body"))).alias("item_no", "item"))
    return entries.select(*keep, "item_no", "item.*")


def scan_rss_files(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files, which Spark splits between items."""
    items = spark.read.format("xml").option("rowTag", "item").schema(ITEM_FILE_SCHEMA).load(path)
    return items.select("title", F.col("link").alias("url"), item_text(F.col("summary"), F.col("description")).alias("text"))
