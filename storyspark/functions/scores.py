"""Event scores and their reason codes as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def codes(*conditions: tuple[Column, str]) -> Column:
    """Codes whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for condition, code in conditions]))


def decay(first_seen_at: Column, as_of: Column) -> Column:
    """Exponential decay with an e-folding time of two hours; above 1 for a future first sighting."""
    return F.exp(-(elapsed_seconds(first_seen_at, as_of) / 3600) / 2.0)


def breaking_score(
    tier: Column,
    velocity: Column,
    source_count: Column,
    first_seen_at: Column,
    as_of: Column,
    base_weight: float = 10.0,
) -> Column:
    raw = (
        F.lit(base_weight)
        + (F.lit(4) - tier) * 2.0
        + F.log1p(velocity.cast("double")) * 5.0
        + F.sqrt(source_count.cast("double")) * 3.0
    )
    return F.round(raw * decay(first_seen_at, as_of), 2)


def breaking_reasons(
    tier: Column, velocity: Column, source_count: Column, first_seen_at: Column, as_of: Column
) -> Column:
    spike, tier_weight, diversity, decayed = fixed.BREAKING_REASONS
    return codes(
        (velocity > 5, spike),
        (tier == 1, tier_weight),
        (source_count > 2, diversity),
        (decay(first_seen_at, as_of) < 0.8, decayed),
    )


def evidence_multiplier(evidence: Column) -> Column:
    return F.lit(1.0) + evidence / 5.0


def coverage_lag(has_tier1: Column) -> Column:
    return F.when(has_tier1, F.lit(0.0)).otherwise(F.lit(10.0))


def gap_score(evidence: Column, has_tier1: Column, is_official: Column, base_weight: float = 5.0) -> Column:
    official = F.when(is_official, F.lit(5.0)).otherwise(F.lit(0.0))
    raw = (F.lit(base_weight) + official + coverage_lag(has_tier1)) * evidence_multiplier(evidence)
    return F.round(F.least(raw, F.lit(100.0)), 2)


def gap_reasons(evidence: Column, has_tier1: Column, is_official: Column) -> Column:
    strong, lag, official = fixed.GAP_REASONS
    return codes((evidence > 3.0, strong), (~has_tier1, lag), (is_official, official))


def passes_alert_gate(
    breaking: Column, gap: Column, threshold: float = fixed.ALERT_SCORE_THRESHOLD
) -> Column:
    return (breaking > threshold) | (gap > threshold)
