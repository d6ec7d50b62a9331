"""How fast an event was when each of its documents came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.functions import fixed_values as fixed
from storyspark.session import stage


def velocity_at_arrival(event_docs: DataFrame, minutes: int = fixed.VELOCITY_WINDOW_MINUTES, bucket_s: int = 60) -> DataFrame:
    """``event_id, doc_id, velocity``: documents of the event in the ``minutes`` up to a document's own time, both ends included.

    ``velocity`` is the number seen up to the time less the number seen before the window. Both are running sums: inside buckets of
    ``bucket_s`` seconds over the rows, and over one row per bucket across them. So a hot event has a task for each of its buckets,
    and no frame spans the whole window. Rows without time are left out.
    """
    span, width = minutes * 60_000_000, bucket_s * 1_000_000
    seen = event_docs.select("event_id", "doc_id", F.unix_micros("seen_at").alias("t")).filter("t is not null")
    counts = seen.groupBy("event_id", "t").agg(F.count("*").alias("n"))
    # Every time asks twice: for the sum up to itself, and for the sum before its window, where no row of the event may lie.
    asks = F.array(
        F.struct(F.col("t").alias("place"), F.col("n").alias("rows"), F.lit(1).alias("sign")),
        F.struct((F.col("t") - span - 1).alias("place"), F.lit(0).cast("bigint").alias("rows"), F.lit(-1).alias("sign")),
    )
    marks = stage(counts.select("event_id", "t", F.inline(asks)).withColumn("bucket", F.floor(F.col("place") / width)), "velocity-marks")
    inside = W.partitionBy("event_id", "bucket").orderBy("place").rangeBetween(W.unboundedPreceding, 0)
    running = marks.withColumn("inner", F.sum("rows").over(inside))
    totals = marks.groupBy("event_id", "bucket").agg(F.sum("rows").alias("total"))
    before = W.partitionBy("event_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("event_id", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("carried"))
    summed = running.join(carried, ["event_id", "bucket"]).groupBy("event_id", "t").agg(F.sum(F.col("sign") * (F.col("inner") + F.col("carried"))).alias("velocity"))
    return seen.join(summed, ["event_id", "t"]).select("event_id", "doc_id", "velocity")
