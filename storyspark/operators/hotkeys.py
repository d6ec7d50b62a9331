"""Joins and look-backs that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A key with at least this many rows is "hot". A table of N rows has at most N / HOT_ROWS hot keys,
# which bounds the broadcast below: 40 billion rows give at most 8,000 lookup rows.
HOT_ROWS = 5_000_000
# Words of 64 bits of a map of keys, 2 MB whatever their number.
MAP_WORDS = 2**18


def attach_unique(
    facts: DataFrame, lookup: DataFrame, key: str, rows_per_key: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of many-rows-per-key ``facts`` with one-row-per-key ``lookup``.

    ``lookup[rows_per_key]`` is the number of fact rows of each key. Hot keys are joined by broadcast
    where their rows already are; all other keys take the ordinary shuffle join.
    """
    hot = F.broadcast(lookup.filter(F.col(rows_per_key) >= hot_rows).drop(rows_per_key))
    cold = lookup.filter(F.col(rows_per_key) < hot_rows).drop(rows_per_key)
    return facts.join(hot, key).unionByName(
        facts.join(hot.select(key), key, "left_anti").join(cold, key)
    )


def rows_among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose ``key``, null too, is among those of ``wanted``, and a few others.

    They are found by a broadcast bit map of fixed size, so that the others stay where they are. Where very many keys are wanted it lets more rows pass.
    """
    place = F.pmod(F.xxhash64(key), F.lit(64 * MAP_WORDS))
    word, bit = F.floor(place / 64).cast("int"), (place % 64).cast("int")
    marked = wanted.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = rows.select(*rows.columns, word.alias("_word"), bit.alias("_place")).join(F.broadcast(marked), "_word")
    return held.filter(F.call_function("shiftright", F.col("_bits"), F.col("_place")).bitwiseAND(1) == 1).select(*rows.columns)


def with_previous(
    df: DataFrame, keys: list[str], order: str, chunk: Column, value: Column, name: str
) -> DataFrame:
    """Add ``name``: ``value`` of the previous row of the same keys by ``order``.

    Equal to ``lag`` over the whole key, but a key is sorted in chunks: ``lag`` runs inside each chunk and
    only one closing row per chunk crosses over. ``chunk`` must not decrease as ``order`` increases.
    """
    return _neighbour(df, keys, order, chunk, value, name, F.lag, F.max_by)


def with_next(df: DataFrame, keys: list[str], order: str, chunk: Column, value: Column, name: str) -> DataFrame:
    """Like :func:`with_previous` with the following row: ``lead`` in chunks."""
    return _neighbour(df, keys, order, chunk, value, name, F.lead, F.min_by)


def _neighbour(df: DataFrame, keys: list[str], order: str, chunk: Column, value: Column, name: str, step, edge) -> DataFrame:
    chunked = df.withColumn("_chunk", chunk).withColumn("_value", value)
    inside = W.partitionBy(*keys, "_chunk").orderBy(order)
    rows = chunked.withColumn("_inside", step("_value").over(inside))
    edges = chunked.groupBy(*keys, "_chunk").agg(edge("_value", order).alias("_edge"))
    carried = edges.select(
        *keys, "_chunk", step("_edge").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_carried")
    )
    return (
        rows.join(carried, [*keys, "_chunk"], "left")
        .withColumn(name, F.coalesce("_inside", "_carried"))
        .drop("_chunk", "_value", "_inside", "_carried")
    )
