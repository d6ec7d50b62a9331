"""Micro-batches handled in event-time order.

A row waits until the newest row is ``late_by_s`` seconds ahead of it; then all rows up to that horizon are handed over, in whatever order
they came, with the state that the handler kept. Rows at or before a horizon that has passed are dropped, as behind a watermark.

Waiting rows, those of the last ``late_by_s`` seconds, lie in three slots that later batches overwrite: a batch reads the slot of the batch before and
writes its own. State that lasts, such as the last row of every event, is a bucketed table: a batch reads and writes the buckets of the events that its rows
name, and no others. State without a key, which must pass away by itself, lies in slots like the rows. The output of a batch replaces the partition of its
number: a batch that is repeated changes nothing. The checkpoint lies beside the output, so a stream that is started again on
one folder goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.session import stage
from storyspark.sinks.bucketed import BucketTable
from storyspark.streaming.runner import for_each_batch

#: ``(state, rows up to the horizon, horizon) -> (output, new state)``
Step = Callable[[DataFrame, DataFrame, Column], tuple[DataFrame, DataFrame]]
SLOTS = 3


def run_ordered(
    rows: DataFrame,
    spark: SparkSession,
    folder: str,
    at: str,
    late_by_s: int,
    state_schema: str,
    out_schema: str,
    step: Step,
    every: str | None = None,
    key: str | None = None,
    n_buckets: int = 16,
) -> DataFrame:
    """Run ``step`` over the micro-batches of ``rows`` by time ``at``; returns the output of all batches so far.

    With a ``key`` the step gets the state of the keys that its rows have, and what it returns takes the place of that.
    """
    schema = rows.schema

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        slot = lambda name, number: f"{folder}/{name}/{number % SLOTS}"
        if batch_id:
            newest, passed = session.read.parquet(slot("_times", batch_id - 1)).first()
            waiting = session.read.schema(schema).parquet(slot("_rows", batch_id - 1)).filter(F.col(at) > F.timestamp_micros(F.lit(passed)))
            fresh = batch.filter(F.col(at) > F.timestamp_micros(F.lit(passed)))
        else:
            newest, waiting, fresh = None, batch.limit(0), batch
        waiting.unionByName(fresh).write.mode("overwrite").parquet(slot("_rows", batch_id))
        held = session.read.schema(schema).parquet(slot("_rows", batch_id))
        latest = held.agg(F.max(F.unix_micros(at))).first()[0]
        newest = max((t for t in (newest, latest) if t is not None), default=0)
        horizon = newest - late_by_s * 1_000_000
        session.createDataFrame([(newest, horizon)], "newest bigint, passed bigint").coalesce(1).write.mode("overwrite").parquet(slot("_times", batch_id))
        limit = F.timestamp_micros(F.lit(horizon))
        ready = held.filter(F.col(at) <= limit)
        if key:
            table = BucketTable(session, f"{folder}/_state", state_schema, key, n_buckets)
            state = table.read(table.buckets_of(ready), batch_id).join(ready.select(key).distinct(), key, "left_semi")
            out, kept = step(state, ready, limit)
            out.write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")
            table.upsert(stage(kept, "stream-state"), batch_id)
        else:
            state = session.read.schema(state_schema).parquet(slot("_state", batch_id - 1)) if batch_id else session.createDataFrame([], state_schema)
            out, kept = step(state, ready, limit)
            out.write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")
            kept.write.mode("overwrite").parquet(slot("_state", batch_id))

    for_each_batch(rows, spark, f"{folder}/_checkpoint", handle, every)
    try:
        return spark.read.schema(out_schema).parquet(f"{folder}/data")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], out_schema)
