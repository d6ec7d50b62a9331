"""Longest-suffix lookup of host names in a table of any size, as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions.text import normalize_text
from storyspark.session import stage


def host_suffixes(host: Column) -> Column:
    """The host and everything behind one of its dots, longest first: ``a.b.c``, ``b.c``, ``c``."""
    parts = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def longest_suffix(rows: DataFrame, table: DataFrame, host: str = "host") -> DataFrame:
    """``rows`` with the other columns of ``table (suffix, ...)`` for the longest suffix that the host equals or lies under, null without one.

    Hosts are compared normalised. Every distinct host meets the table once, by equality with each of its suffixes, so the cost
    doesn't grow with the size of the table; of several rows of one suffix the greatest counts. Names must not clash with those of ``rows``.
    """
    values = [c for c in table.columns if c != "suffix"]
    known = table.groupBy("suffix").agg(F.max(F.struct(*values)).alias("_value"))
    hosts = rows.select(F.col(host).alias("_host")).distinct()
    spread = hosts.select("_host", F.explode(host_suffixes(normalize_text(F.col("_host")))).alias("suffix")).filter("suffix <> ''")
    best = spread.join(known, "suffix").groupBy("_host").agg(F.max_by("_value", F.length("suffix")).alias("_value"))
    best = stage(best, "host-suffixes")
    return rows.join(best, rows[host] == best["_host"], "left").select(*(rows[c] for c in rows.columns), *(F.col("_value")[c].alias(c) for c in values))
