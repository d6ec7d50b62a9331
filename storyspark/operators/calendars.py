"""Yield baselines by calendar: what a source brings in working hours, on weekends and on holidays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.operators.health import BASELINE_DAYS
from storyspark.operators.intervals import join_containing

_DAY = 86_400
OUTSIDE = "none"


def working_calendars(days: DataFrame, calendars: DataFrame, holidays: DataFrame) -> DataFrame:
    """``calendar, period, priority, starts_at, ends_at`` (seconds) of every day of ``days (day)`` in every calendar.

    ``calendars``: ``calendar, open_hour, close_hour``; ``holidays``: ``calendar, day``. A day is ``off``, within it the hours from opening
    to closing are ``work``; Saturdays and Sundays are ``weekend``, and a holiday is ``holiday`` all day. Of several periods the
    one of the highest priority holds. ``calendars`` is a handful of rows.
    """
    start = F.unix_timestamp(F.col("day").cast("timestamp"))
    # The key is 0 in all rows but no constant, so this stays a join by equality whatever the sizes.
    zero = lambda column: F.pmod(F.xxhash64(column), F.lit(1))
    dated = days.select("day").distinct().withColumn("_zero", zero("day")).join(calendars.withColumn("_zero", zero("calendar")), "_zero")
    weekend = F.dayofweek("day").isin(1, 7)

    def period(name: str, priority: int, first, last):
        return F.struct(F.lit(name).alias("period"), F.lit(priority).alias("priority"), first.alias("starts_at"), last.alias("ends_at"))

    hours = (start + F.col("open_hour") * 3600, start + F.col("close_hour") * 3600)
    plain = F.array(period("off", 0, start, start + _DAY), period("work", 1, *hours))
    regular = dated.select("calendar", F.inline(F.when(weekend, F.array(period("weekend", 1, start, start + _DAY))).otherwise(plain)))
    free = holidays.select("calendar", F.inline(F.array(period("holiday", 2, start, start + _DAY))))
    return regular.unionByName(free)


def yield_baseline_calendar(attempts: DataFrame, sources: DataFrame, calendar: DataFrame) -> DataFrame:
    """``source_id, slot, period, attempts, mean_yield, baseline_yield``: each hour of a source next to the hours of the same period before it.

    ``attempts``: ``source_id, attempted_at, yield_count``; ``sources``: ``source_id, calendar``, the ``calendar_profile`` of a source, which
    may be null; ``calendar``: periods as :func:`working_calendars` gives them, or any others. An hour belongs to the period of highest priority, then of least
    name, in which it starts, or to ``none``. The baseline is the mean over the last four weeks, the hour itself left out. Attempts are summed per hour first.
    """
    slots = attempts.groupBy("source_id", F.date_trunc("hour", "attempted_at").alias("slot")).agg(F.count("*").alias("attempts"), F.sum("yield_count").alias("total_yield"))
    placed = slots.join(sources.select("source_id", "calendar"), "source_id", "left").withColumn("_at", F.unix_timestamp("slot"))
    points = placed.filter("calendar is not null").select("calendar", "_at").distinct()
    found = join_containing(points, calendar, ["calendar"], "_at", "starts_at", "ends_at")
    best = found.groupBy("calendar", "_at").agg(F.min_by("period", F.struct(-F.col("priority"), F.col("period"))).alias("period"))
    named = placed.join(best, ["calendar", "_at"], "left").withColumn("period", F.coalesce("period", F.lit(OUTSIDE)))
    same = W.partitionBy("source_id", "period").orderBy("_at").rangeBetween(-BASELINE_DAYS * _DAY, -1)
    return named.select(
        "source_id",
        "slot",
        "period",
        "attempts",
        (F.col("total_yield") / F.col("attempts")).alias("mean_yield"),
        (F.sum("total_yield").over(same) / F.sum("attempts").over(same)).alias("baseline_yield"),
    )
