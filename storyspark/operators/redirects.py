"""Redirects as of a time: a merged event can be sent to another target later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.session import stage

_FIRST, _LAST = -(2**62), 2**62


def _chunks(times: DataFrame) -> Callable[[Column], Column]:
    """A number that grows with a time and cuts the column ``at`` of ``times`` in some chunks for each partition of a shuffle; what is before all is its own."""
    first, last = times.filter(F.col("at") > _FIRST).agg(F.min("at"), F.max("at")).first()
    chunks = 8 * int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = 1 if first is None else (last - first) // chunks + 1
    return lambda at: F.greatest(F.floor((at - F.lit(first or 0)) / F.lit(width)), F.lit(-1))


def _numbered(marks: DataFrame, chunk: Callable[[Column], Column]) -> DataFrame:
    """``id, at, until, rank, target`` of ``marks (id, at, target)``: when the next mark of the id comes, and its place among them.

    A mark with the target of the one before in its chunk says nothing new and goes. No task sorts a whole id.
    """
    inside = W.partitionBy("id", "chunk").orderBy("at")
    rows = marks.withColumn("chunk", chunk(F.col("at")))
    rows = rows.withColumn("same", F.col("target").eqNullSafe(F.lag("target").over(inside)) & (F.row_number().over(inside) > 1)).filter("not same").drop("same")
    rows = stage(rows.withColumns({"rank": F.row_number().over(inside), "until": F.lead("at").over(inside)}), "redirect-chunks")
    over = W.partitionBy("id").orderBy("chunk")
    edges = rows.groupBy("id", "chunk").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    edges = edges.select(
        F.col("id").alias("_id"), F.col("chunk").alias("_chunk"), F.lead("first").over(over).alias("_next"), F.coalesce(F.sum("n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base")
    )
    joined = rows.join(edges, rows["id"].eqNullSafe(edges["_id"]) & (rows["chunk"] == edges["_chunk"]))
    return joined.select("id", "at", F.coalesce("until", "_next", F.lit(_LAST)).alias("until"), (F.col("rank") + F.col("_base")).alias("rank"), "target")


def _onward(steps: DataFrame, chunk: Callable[[Column], Column]) -> DataFrame:
    """``id, at, target, first, last`` of the ``steps`` that lead elsewhere: the ranks of the target's marks in force when the step begins and before it ends.

    They are sought as in :func:`_in_force`; null where the target has no marks.
    """
    leading = steps.filter("target <> id")
    ends = F.inline(F.array(F.struct(F.col("at").alias("when"), F.lit(True).alias("begins")), F.struct((F.col("until") - 1).alias("when"), F.lit(False).alias("begins"))))
    asked = leading.select("target", "id", "at", ends).withColumn("rank", F.lit(None).cast("bigint"))
    given = steps.select(F.col("id").alias("target"), F.lit(None).cast(steps.schema["id"].dataType).alias("id"), F.lit(None).cast("bigint").alias("at"), F.col("at").alias("when"), F.lit(None).cast("boolean").alias("begins"), "rank")
    rows = asked.unionByName(given).withColumn("chunk", chunk(F.col("when")))
    inside = W.partitionBy("target", "chunk").orderBy("when").rangeBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("target").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy("target", "chunk").agg(F.max("rank").alias("rank")).select("target", "chunk", F.max("rank").over(before).alias("carried"))
    sought = rows.withColumn("inside", F.max("rank").over(inside)).filter("begins is not null").join(carried, ["target", "chunk"])
    found = sought.withColumn("rank", F.coalesce("inside", "carried"))
    return found.groupBy("id", "at", "target").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))


def redirect_periods(redirects: DataFrame) -> DataFrame:
    """``id, target, valid_from, valid_to``: where each redirected event leads in each period, through any chain, in microseconds.

    ``redirects``: ``from_event_id, to_event_id, valid_from`` (timestamp); a later row of an event replaces the one before, of several at one
    time the greatest target counts, and an event without target, or before its first row, stands for itself. A row without time never begins. Chains are
    doubled: each round puts together two steps wherever their periods overlap, so a chain of any length takes a logarithmic number of rounds.
    What a step overlaps are consecutive periods of its target, which it takes by their numbers, so a round costs as much as the periods that it makes.
    Most periods that follow each other with one target are one. A ring of redirects at one time is an error.
    """
    rows = redirects.select(F.col("from_event_id").alias("id"), F.coalesce("to_event_id", "from_event_id").alias("target"), F.unix_micros("valid_from").alias("at"))
    rows = rows.filter("at is not null").groupBy("id", "at").agg(F.max("target").alias("target"))
    itself = rows.select("id").distinct().select("id", F.lit(_FIRST).alias("at"), F.col("id").alias("target"))
    marks = stage(rows.unionByName(itself), "redirect-marks")
    chunk = _chunks(marks)
    # No chain is longer than there are events, and each round doubles what a step covers; the last finds nothing to do.
    for _ in range(itself.count().bit_length() + 2):
        steps = stage(_numbered(marks, chunk), "redirect-periods")
        spans = stage(_onward(steps, chunk).filter("first is not null"), "redirect-spans")
        pieces = spans.select("id", "at", "target", F.explode(F.sequence("first", "last")).alias("rank"))
        onward = steps.select(F.col("id").alias("_id"), F.col("rank").alias("_rank"), F.col("at").alias("_at"), F.col("target").alias("_next"))
        led = pieces.join(onward, (F.col("target") == F.col("_id")) & (F.col("rank") == F.col("_rank")))
        led = stage(led.select("id", F.greatest("at", "_at").alias("at"), F.col("_next").alias("target"), (F.col("_next") != F.col("target")).alias("moved")), "redirect-led")
        if led.filter("moved").isEmpty():
            return steps.select("id", "target", F.col("at").alias("valid_from"), F.col("until").alias("valid_to"))
        known = spans.select(F.col("id").alias("_id"), F.col("at").alias("_at"))
        kept = steps.join(known, steps["id"].eqNullSafe(known["_id"]) & (steps["at"] == known["_at"]), "left_anti")
        marks = led.select("id", "at", "target").unionByName(kept.select("id", "at", "target"))
    raise ValueError("redirects form a ring")


def _in_force(points: DataFrame, periods: DataFrame) -> DataFrame:
    """``id, _at, target`` of the ``points (id, _at)`` that lie in one of the ``periods``, which do not overlap for one id.

    Each point takes the latest period that began by then. Time is cut in chunks: the latest is sought inside a chunk, and one row per id and chunk
    carries the last of the chunks before. So every row moves once, and no task sorts a whole hot id.
    """
    chunk = _chunks(points.withColumnRenamed("_at", "at"))
    begun = periods.select("id", F.col("valid_from").alias("_at"), F.struct("target", "valid_to").alias("_own"))
    rows = points.select("id", "_at", F.lit(None).cast(begun.schema["_own"].dataType).alias("_own"), F.lit(True).alias("_asks"))
    rows = rows.unionByName(begun.withColumn("_asks", F.lit(False))).withColumn("_chunk", chunk(F.col("_at")))
    inside = W.partitionBy("id", "_chunk").orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    latest = F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("_at"))).alias("_latest")
    before = W.partitionBy("id").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy("id", "_chunk").agg(latest).select("id", "_chunk", F.last("_latest", ignorenulls=True).over(before).alias("_carried"))
    sought = rows.withColumn("_inside", F.last("_own", ignorenulls=True).over(inside)).filter("_asks").join(carried, ["id", "_chunk"])
    found = sought.select("id", "_at", F.coalesce("_inside", "_carried").alias("_period"))
    return found.filter(F.col("_at") < F.col("_period.valid_to")).select("id", "_at", "_period.target")


def redirects_as_of(readers: DataFrame, redirects: DataFrame, at: str = "at", event: str = "event_id") -> DataFrame:
    """``readers`` with ``target_event_id``: what the event stood for at the reader's own time. Null times read the event itself."""
    periods = redirect_periods(redirects).filter("id <> target")
    asked = readers.select(event, at).distinct().select(F.col(event).alias("id"), F.unix_micros(at).alias("_at"))
    found = _in_force(asked.filter("id is not null and _at is not null"), periods)
    joined = readers.join(found, (F.col(event) == F.col("id")) & (F.unix_micros(at) == F.col("_at")), "left")
    return joined.select(*(readers[c] for c in readers.columns), F.coalesce("target", F.col(event)).alias("target_event_id"))
