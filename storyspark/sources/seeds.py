"""The eight starting sources as a source table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from storyspark import schemas
from storyspark.functions import fixed_values as fixed


def seed_sources(spark: SparkSession) -> DataFrame:
    rows = []
    for number, seed in enumerate(fixed.SEED_SOURCES, 1):
        domain, name, official, key, source_domain, pool, strategy, kind, url, cron, seconds, per_minute = seed
        policy = {
            "source_id": key,
            "source_domain": source_domain,
            "tier": fixed.SEED_TIER,
            "pool": pool,
            "strategy": strategy,
            "endpoints": {kind: url},
            "cadence": {"cron": cron} if cron else {"interval_seconds": seconds},
            "limits": {"rate_limit_req_per_min": per_minute},
        }
        rows.append((number, domain, name, fixed.SEED_TIER, official, "pt-BR", json.dumps(policy), True))
    return spark.createDataFrame(rows, schemas.SOURCES)
