"""Source profiles: reading the JSON policy, defaults, validation and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark import schemas
from storyspark.functions import fixed_values as fixed
from storyspark.functions.scores import codes
from storyspark.functions.text import cron_is_valid, non_empty


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled")


def parse_profiles(sources: DataFrame) -> DataFrame:
    """Profile columns with defaults filled in, and ``errors``: the codes of all broken rules."""
    policy = sources.withColumn("p", F.from_json("fetch_policy_json", schemas.SOURCE_POLICY))
    default = fixed.PROFILE_DEFAULTS

    def filled(path: str) -> Column:
        name = path.split(".")[-1]
        return F.coalesce(F.col(f"p.{path}"), F.lit(default[name])).alias(name)

    limits = ("rate_limit_req_per_min", "concurrency_per_domain", "timeout_seconds", "max_bytes")
    parsed = policy.select(
        "id",
        "domain",
        F.col("p").isNotNull().alias("is_object"),
        F.col("p.source_id").alias("source_key"),
        F.coalesce("p.source_domain", "domain").alias("source_domain"),
        "p.tier",
        filled("is_official"),
        filled("lang"),
        "p.pool",
        "p.strategy",
        "p.endpoints",
        F.coalesce("p.headers", F.create_map().cast("map<string,string>")).alias("headers"),
        "p.cadence",
        *[filled(f"limits.{name}") for name in limits],
        filled("observability.starvation_window_hours"),
        F.coalesce("p.observability.yield_keys", F.array().cast("array<string>")).alias("yield_keys"),
        filled("observability.baseline_rolling"),
        F.col("p.observability.calendar_profile").alias("calendar_profile"),
    )
    return parsed.withColumn("errors", profile_errors())


def profile_errors() -> Column:
    """Codes of the rules a parsed profile breaks."""

    def broken(rule: Column) -> Column:
        return ~F.coalesce(rule, F.lit(False))

    minimums = [(broken(F.col(name) >= least), f"{name}_too_small") for name, least in fixed.PROFILE_MINIMUMS.items()]
    return codes(
        (F.col("source_key").isNull(), "source_id_missing"),
        (broken(F.col("tier").between(1, 3)), "tier_out_of_range"),
        (broken(F.col("pool").isin(*fixed.POOLS)), "pool_unknown"),
        (broken(F.col("strategy").isin(*fixed.STRATEGIES)), "strategy_unknown"),
        (broken(F.size("endpoints") > 0), "endpoints_empty"),
        (F.col("cadence").isNull(), "cadence_missing"),
        (broken(cron_is_valid(F.col("cadence.cron"))) & F.col("cadence").isNotNull(), "cron_fields"),
        *minimums,
    )


def active_profiles(sources: DataFrame) -> DataFrame:
    """Valid profiles of enabled sources."""
    return parse_profiles(enabled_sources(sources)).filter(F.size("errors") == 0).drop("errors", "is_object")


def rejected_profiles(sources: DataFrame) -> DataFrame:
    """Enabled sources whose profile is broken, with the reasons."""
    return parse_profiles(enabled_sources(sources)).filter(F.size("errors") > 0).select("id", "domain", "errors")


def fetch_queue(pool: Column) -> Column:
    """Queue that fetches sources of a pool."""
    queue = F.lit(fixed.DEFAULT_QUEUE)
    for name, target in fixed.POOL_QUEUES.items():
        queue = F.when(pool == name, F.lit(target)).otherwise(queue)
    return queue


def endpoint(endpoints: Column, *names: str) -> Column:
    """First non-empty endpoint of the given names, or null."""
    return F.coalesce(*[non_empty(F.try_element_at(endpoints, F.lit(name))) for name in names])


def fetch_url(endpoints: Column) -> Column:
    return endpoint(endpoints, "feed", "latest", "api")


def document_url(item_url: Column, endpoints: Column) -> Column:
    """Address of a document: its own link, else the source's feed or listing."""
    return F.coalesce(non_empty(item_url), endpoint(endpoints, "feed", "latest"))
