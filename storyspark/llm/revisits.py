"""Not-modified revisit resolution for web archives (operator 1).

A revisit record says that a server answered 304: the page is as it was. It is joined, as of its time, to the latest earlier
full response of the same canonical URL, its validators are checked against that response's, and the headers that a 304 may carry
replace those of the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.session import stage

#: Fixed value: header fields of a 304 that replace stored ones; those that describe the body stay as stored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Records in one slice of time, on average.
SLICE_ROWS = 1_000_000
#: Query parameters that don't choose content.
_TRACKING = r"(?:utm_[^=&]*|ref|gclid|fbclid)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, no scheme, fragment, tracking parameters or final slash; null stays null."""
    bare = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:www\.)?|#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    host = F.regexp_replace(host, r":(?:80|443)$", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    cleaned = F.regexp_replace(rest, rf"([?&])(?:{_TRACKING}=[^&]*(?:&|$))+", "$1")
    return F.concat(host, F.regexp_replace(F.regexp_replace(cleaned, r"[?&]+$", ""), r"/+$", ""))


def _etag(tag: Column) -> Column:
    """The opaque part: revisits compare weakly."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """``stored`` with the permitted fields of ``fresh``; names in lower case, null maps are empty, of names that are equal but for case the last counts."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")

    def lower(headers: Column) -> Column:
        fields = F.transform(F.map_entries(F.coalesce(headers, empty)), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
        names = F.array_distinct(F.transform(fields, lambda f: f["name"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(fields, lambda f: f["name"] == n), -1)["value"]))

    taken = F.map_filter(lower(fresh), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(lower(stored), lambda k, _: ~F.array_contains(F.map_keys(taken), k))
    return F.map_concat(kept, taken)


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per revisit of ``records (record_id, url, captured_at, kind, etag, last_modified, headers)``.

    ``captured_at`` is a number of seconds, ``kind`` is ``response`` or ``revisit``, ``headers`` a map. The result has ``record_id,
    canonical_url, original_id, status, headers``: ``status`` is ``resolved`` if the ETags agree, or, where one is missing,
    the Last-Modified times; ``changed`` if they differ; ``unchecked`` if the two records share no validator; ``unmatched`` without an earlier response,
    or if URL or time are null. ``headers`` are merged for resolved and unchecked records, else the revisit's own.

    Records of one time follow each other by ``record_id``, null first; a response never serves revisits at the same time with a smaller id. Repeated rows give
    repeated results, an empty table none. Other columns, whatever their names, are not used. Only headers move; records of one URL are spread over slices of time, and each slice
    gets the last response of those before, so that a URL with a third of all records has many tasks.
    """
    keyed = stage(
        records.select(
            "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("captured_at").cast("double").alias("at"), "kind", "etag", "last_modified", "headers"
        ),
        "revisit-records",
    )
    rows, first, last = keyed.agg(F.count("*"), F.min("at"), F.max("at")).first()
    slices = max(1, -(-rows // slice_rows))
    width = ((last or 0.0) - (first or 0.0)) / slices or 1.0
    usable = F.col("canonical_url").isNotNull() & F.col("at").isNotNull()
    sliced = keyed.filter(usable).withColumn("slice", F.floor((F.col("at") - F.lit(first or 0.0)) / F.lit(width)).cast("int"))
    response = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "headers"))
    sliced = sliced.withColumn("response", response)
    inside = W.partitionBy("canonical_url", "slice").orderBy("at", "record_id").rowsBetween(W.unboundedPreceding, -1)
    seen = sliced.withColumn("inner", F.last("response", ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    closing = sliced.filter("kind = 'response'").groupBy("canonical_url", "slice").agg(F.max_by("response", F.struct("at", "record_id")).alias("closing"))
    wanted = seen.filter("inner is null").select("canonical_url", "slice").distinct().join(closing, ["canonical_url", "slice"], "full")
    before = W.partitionBy("canonical_url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = wanted.withColumn("carried", F.last("closing", ignorenulls=True).over(before)).drop("closing")
    found = seen.join(carried, ["canonical_url", "slice"], "left").withColumn("original", F.coalesce("inner", "carried"))
    lost = keyed.filter(~usable & (F.col("kind") == "revisit")).withColumn("original", F.lit(None).cast(found.schema["original"].dataType))
    columns = ["record_id", "canonical_url", "etag", "last_modified", "headers", "original"]
    every = found.select(*columns).unionByName(lost.select(*columns))
    tags = F.col("etag").isNotNull() & F.col("original.etag").isNotNull()
    times = F.col("last_modified").isNotNull() & F.col("original.last_modified").isNotNull()
    agree = F.when(tags, _etag(F.col("etag")) == _etag(F.col("original.etag"))).when(times, F.col("last_modified") == F.col("original.last_modified"))
    status = F.when(F.col("original").isNull(), "unmatched").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("changed")
    judged = every.withColumn("status", status)
    merged = F.when(F.col("status").isin("resolved", "unchecked"), merged_headers(F.col("original.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return judged.select("record_id", "canonical_url", F.col("original.record_id").alias("original_id"), "status", merged.alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records of a table of page captures ``(page_id, url, html)``, by rules on a number mixed from the id.

    Every page is captured at the second ``page_id``; of one in 13 the capture is lost. Two thirds are asked for again later, up to 1,000
    seconds, with the ETag of the page, an md5 of its title; one such request in seven meets another version. A request has the
    negative of the page's id, less one. Null ids have a capture without time.
    """
    mixed = F.coalesce(F.pmod("page_id", F.lit(2**31)) * F.lit(2654435761) % F.lit(2**32), F.lit(1))
    title = F.md5(F.regexp_extract(F.coalesce("html", F.lit("")), r"<title>([^<]*)", 1).cast("binary"))
    seen = pages.select("page_id", "url", mixed.alias("mixed"), F.concat(F.lit('"'), title, F.lit('"')).alias("tag"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    none = F.lit(None).cast("string")
    date = lambda at: F.concat(F.lit("second "), at.cast("string"))
    full = F.struct(
        F.col("page_id").alias("record_id"),
        F.col("page_id").alias("captured_at"),
        F.lit("response").alias("kind"),
        F.col("tag").alias("etag"),
        F.create_map(F.lit("Date"), F.coalesce(date(F.col("page_id")), F.lit("")), F.lit("ETag"), F.col("tag"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size")).alias("headers"),
    )
    later = F.col("page_id") + F.col("mixed") % 1000 + 1
    asked = F.concat(F.lit("W/"), F.when(F.col("mixed") % 7 == 0, F.lit('"another"')).otherwise(F.col("tag")))
    again = F.struct(
        (-F.col("page_id") - 1).alias("record_id"),
        later.alias("captured_at"),
        F.lit("revisit").alias("kind"),
        asked.alias("etag"),
        F.create_map(F.lit("Date"), F.coalesce(date(later), F.lit("")), F.lit("ETag"), asked, F.lit("Content-Length"), F.lit("0")).alias("headers"),
    )
    records = F.filter(F.array(F.when(F.col("mixed") % 13 != 0, full), F.when(F.col("mixed") % 3 != 0, again)), lambda r: r.isNotNull())
    return seen.select("url", F.inline(records), none.alias("last_modified"))
