"""Session settings and staged tables.

Stages that are read more than once, and every round of an iterative operator, are written as
parquet below the shared folder named by ``spark.checkpoint.dir``. A lost executor then costs a
re-read of that folder, never a recomputation of earlier rounds.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

STAGE_FOLDER = "storyspark-stage"
SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app_name: str = "storyspark", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession, code: str | None = None) -> None:
    """Set what a session of one machine lacks: a folder for staged tables and, for Python workers, the path of this code.

    Only a session in local mode without ``spark.checkpoint.dir`` gets a folder of its own; a cluster must name one.
    """
    context = spark.sparkContext
    if not _configured(spark) and re.match(r"local(\[|$)", context.master):
        spark.conf.set(SETTING, tempfile.mkdtemp(prefix="storyspark-"))
    if code and code not in context.environment.get("PYTHONPATH", "").split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (code, context.environment.get("PYTHONPATH"))))


def _configured(spark: SparkSession) -> str | None:
    context = spark.sparkContext
    return spark.conf.get(SETTING, None) or context.getConf().get(SETTING) or context.getCheckpointDir()


def stage_root(spark: SparkSession) -> str:
    """The shared folder for staged tables, named by ``spark.checkpoint.dir``; a session without that setting is an error."""
    context = spark.sparkContext
    configured = _configured(spark)
    if not configured:
        raise ValueError(f"set {SETTING} to a folder that every executor can reach")
    return f"{configured.rstrip('/')}/{STAGE_FOLDER}/{context.applicationId}"


def new_stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Called with the name and the DataFrame of every stage before it is written; for tests that look at plans.
on_stage: Callable[[str, DataFrame], None] | None = None


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that scans the written table."""
    if on_stage:
        on_stage(name, df)
    path = new_stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
