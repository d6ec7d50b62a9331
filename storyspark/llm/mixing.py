"""Mixing sources to target weights as a time-varying curriculum (operator 5).

Each source has a target in words: its share of the budget by weight, at most ``cap`` times its size, what is cut off
going to the others by weight until none is above. A source's documents follow each other in an order by hash, again and again, until
the target is reached; the last one may be cut. When a piece is met in training is decided by the source's schedule: a
weight that changes over time from 0 to 1. Its integral is the cumulative demand for words of that source, and the
inverse of that integral, at the middle of a piece, is the piece's position; pieces are range-sorted by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.llm.common import WORD, partitions
from storyspark.session import stage

#: Hexadecimal digits of the hash by which a source is cut to chunks; a source has up to 16 ** this many.
CHUNK_DIGITS = 4
#: Schedules as (time, weight) from time 0 to time 1, straight lines between: steady, growing and fading.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)), ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)))


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """``source_key, source_size, target, rank`` by source of ``sizes (source_key, source, size)``.

    Sources in code point order, null last, get the weights in turn. Whatever is above ``cap`` times a source's size
    is found in one pass over the sources by falling need: with the sources in ascending order of cap by weight, those that
    reach their cap come first. The windows run over one row per source.
    """
    totals = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    everything = W.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(everything).cast("int")).withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    )
    ranked = ranked.withColumn("top", F.col("source_size") * F.lit(float(cap)))
    by_need = W.orderBy(F.col("top") / F.col("weight"), "rank")
    before, from_here = by_need.rowsBetween(W.unboundedPreceding, -1), by_need.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(budget)) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    stepped = ranked.withColumn("level", level)
    open_level = F.when(F.col("top") > F.col("weight") * F.col("level"), F.struct(F.col("top") / F.col("weight"), "rank", "level"))
    levelled = stepped.withColumn("final", F.min(open_level).over(whole)["level"])
    target = F.when(F.col("final").isNull(), F.col("top")).otherwise(F.least("top", F.col("weight") * F.col("final")))
    return levelled.select("source_key", "source_size", target.alias("target"), "rank")


def _position(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a schedule reaches ``share`` of its whole."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    found, done = None, 0.0
    for area, (t0, w0), (t1, w1) in zip(areas, schedule, schedule[1:], strict=False):
        rest = share * F.lit(sum(areas)) - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        # w0 * d + slope * d * d / 2 = rest, solved without loss of digits where the slope is small.
        step = 2 * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
        done += area
        time = F.lit(t0) + F.least(F.greatest(step, F.lit(0.0)), F.lit(t1 - t0))
        found = F.when(share * F.lit(sum(areas)) <= F.lit(done), time) if found is None else found.when(share * F.lit(sum(areas)) <= F.lit(done), time)
    return found.otherwise(F.lit(schedule[-1][0]))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    budget: float = 1.5,
    cap: float = 2.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
) -> DataFrame:
    """Decide what the mix takes of each row of ``docs (doc_id, text, source)``, one row per row.

    ``doc_id, source, size, source_size, target, taken`` and ``pieces``, an array of ``(pass, taken, position)``: for
    each pass over the source in which the document is taken, how many of its words and when. Rows are range-sorted by
    their first position; those that aren't taken come last. ``size`` is the number of words, 0 for a null text;
    a document without words is never taken. The order within a source is that of the md5 of ``doc_id`` as text (null: empty), then
    ``doc_id``, then size; equal rows take what their places get. Sources and weights: see :func:`source_targets`.

    Only ids, sources and sizes are shuffled. A source's running sum is made in chunks by hash and put together from the
    chunks' sums, so a source with a third of all rows is spread like the others.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    keyed = sized.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn(
        "place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    )
    keyed = stage(keyed.withColumn("chunk", F.substring("place", 1, CHUNK_DIGITS)), "mix-sizes")
    targets = source_targets(keyed, weights, budget, cap)
    sums = keyed.groupBy("source_key", "chunk").agg(F.sum("size").alias("chunk_size"))
    ahead = W.partitionBy("source_key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("chunk_size").over(ahead), F.lit(0))).join(targets, "source_key").drop("chunk_size")
    inside = W.partitionBy("source_key", "chunk").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    begun = keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = begun.join(bases, ["source_key", "chunk"]).withColumn("start", F.col("base") + F.col("inner"))
    demand = F.floor("target").cast("bigint")

    def piece(k: int) -> Column:
        took = F.least(F.greatest(demand - F.lit(k) * F.col("source_size") - F.col("start"), F.lit(0)), F.col("size"))
        middle = F.coalesce(F.try_divide(F.lit(k) * F.col("source_size") + F.col("start") + took / 2, demand), F.lit(0.0))
        n = len(schedules)
        position = F.coalesce(*(F.when((F.col("rank") - 1) % n == i, _position(middle, s)) for i, s in enumerate(schedules)))
        return F.struct(F.lit(k).alias("pass"), took.alias("taken"), position.alias("position"))

    passes = int(-(-cap // 1))  # a target is at most cap times the source
    pieces = F.filter(F.array(*map(piece, range(passes))), lambda p: p["taken"] > 0)
    decided = placed.withColumn("pieces", pieces)
    taken = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda a, p: a + p["taken"])
    first = F.coalesce(F.get("pieces", F.lit(0))["position"], F.lit(2.0))
    return (
        decided.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "pieces", first.alias("first"))
        .repartitionByRange(partitions(docs.sparkSession), "first", "doc_id")
        .sortWithinPartitions("first", "doc_id")
        .drop("first")
    )


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents that a mix takes, one row per piece, range-sorted by position, with the columns of ``docs``.

    A piece of fewer words than its document has the first of them, single spaces between; all others are whole. Rows of
    one id are told apart by their size and then by their place among equals. Texts move once for the join and once for the order.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    alike = W.partitionBy("_id", "_size")
    left = docs.withColumns({"_id": F.col("doc_id").cast("bigint"), "_size": size})
    left = left.withColumn("_n", F.row_number().over(alike.orderBy(F.xxhash64("text"))))
    right = mixed.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("size").alias("_size"), "pieces")
    right = right.withColumn("_n", F.row_number().over(alike.orderBy(F.get("pieces", F.lit(0))["position"].asc_nulls_last())))
    right = right.filter(F.size("pieces") > 0).select(F.col("_id").alias("_id2"), F.col("_size").alias("_size2"), F.col("_n").alias("_n2"), F.inline("pieces").alias("_pass", "_taken", "_at"))
    same = left["_id"].eqNullSafe(right["_id2"]) & (left["_size"] == right["_size2"]) & (left["_n"] == right["_n2"])
    cut = F.when(F.col("_taken") == F.col("_size"), F.col("text")).otherwise(
        F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})")), 1, F.col("_taken").cast("int")), " ")
    )
    joined = left.join(right, same).withColumn("text", cut)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("_taken") == F.col("_size"), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    ordered = joined.repartitionByRange(partitions(docs.sparkSession), "_at", "_id").sortWithinPartitions("_at", "_id")
    return ordered.select(*docs.columns)
