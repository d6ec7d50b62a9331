"""Stabbing join of points with half-open intervals by dyadic buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(length: Column) -> Column:
    """The power of two that is at least the length: an interval of that level lies in at most two buckets."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)))).cast("int")


def join_containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Inner join of ``points`` with the ``intervals`` of the same ``keys`` for which ``start <= at < end``, whole numbers all three.

    An interval is listed in the buckets, as wide as the power of two next to its own length, that it touches: one or two, however long
    it is. A point looks into one bucket for each length that occurs, which are few. So both sides join by equality,
    intervals of a second and of a year alike, and no long interval meets all points. Empty intervals contain nothing.
    """
    sized = intervals.filter(F.col(end) > F.col(start)).withColumn("_level", _level(F.col(end) - F.col(start)))
    listed = sized.withColumn("_bucket", F.expr(f"explode(sequence(shiftright(`{start}`, _level), shiftright(`{end}` - 1, _level)))"))
    levels = [r[0] for r in sized.select("_level").distinct().collect()]  # at most 64 numbers
    if not levels:
        listed, looked = listed.limit(0), points.withColumn("_level", F.lit(0)).withColumn("_bucket", F.lit(0).cast("bigint"))
    else:
        visits = F.array(*(F.struct(F.lit(k).alias("_level"), F.shiftright(at, k).alias("_bucket")) for k in sorted(levels)))
        looked = points.select("*", F.inline(visits))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return looked.join(listed, [*keys, "_level", "_bucket"]).filter(inside).drop("_level", "_bucket")
