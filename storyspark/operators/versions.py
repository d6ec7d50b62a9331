"""Differences between consecutive versions of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.functions import deltas as D
from storyspark.operators.hotkeys import with_previous

VERSIONS_PER_CHUNK = 1_000


def full_deltas(versions: DataFrame) -> DataFrame:
    """One row per version that has an earlier one: ``anchors``, ``values`` and ``temporal`` deltas.

    ``versions``: ``url, version_no, anchors array<string>, value, time``. The earlier version is the closest
    lower number, so gaps in the numbering do not matter. ``versions`` is read twice: pass a written table.
    """
    rows = with_previous(
        versions.select("url", "version_no", "anchors", "value", "time"),
        ["url"],
        "version_no",
        F.floor(F.col("version_no") / VERSIONS_PER_CHUNK),
        F.struct("version_no", "anchors", "value", "time"),
        "old",
    )
    return rows.filter("old IS NOT NULL").select(
        "url",
        F.col("old.version_no").alias("from_version"),
        F.col("version_no").alias("to_version"),
        D.anchor_delta(F.col("old.anchors"), F.col("anchors")).alias("anchors"),
        D.value_delta(F.col("old.value"), F.col("value")).alias("values"),
        D.temporal_delta(F.col("old.time"), F.col("time")).alias("temporal"),
    )
