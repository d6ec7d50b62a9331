"""Structured differences between two versions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def anchor_delta(old: Column, new: Column) -> Column:
    """Distinct anchors that appeared and disappeared, each sorted."""
    none = F.array().cast("array<string>")
    before, after = F.coalesce(old, none), F.coalesce(new, none)
    return F.struct(
        F.sort_array(F.array_except(after, before)).alias("added"),
        F.sort_array(F.array_except(before, after)).alias("removed"),
    )


def value_delta(old: Column, new: Column) -> Column:
    """Null when equal, else both values and their difference with null counted as 0."""
    zero = F.lit(0.0)
    change = F.struct(
        old.alias("from"), new.alias("to"), (F.coalesce(new, zero) - F.coalesce(old, zero)).alias("diff")
    )
    return F.when(~old.eqNullSafe(new), change)


def iso_time(value: Column) -> Column:
    """ISO 8601 with offset, and with six digits of a second if it isn't whole: ``2024-03-01T00:00:00.250000+00:00``."""
    micros = F.pmod(F.unix_micros(value), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.date_format(value, "xxx"))


def temporal_delta(old: Column, new: Column) -> Column:
    """Null when equal, else both times and whether the new one is later (null if either is null)."""
    change = F.struct(
        iso_time(old).alias("previous_time"), iso_time(new).alias("new_time"), (new > old).alias("is_postponed")
    )
    return F.when(~old.eqNullSafe(new), change)
