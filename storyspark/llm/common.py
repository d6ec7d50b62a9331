"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: What stands between words.
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{GAP}|{GAP}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def id_crc(doc_id: Column) -> Column:
    """crc32 of a document id as text, by which rows are dealt to folds."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(docs: DataFrame, n: int) -> list[int]:
    """Ascending numbers that cut the ids of ``docs`` into about ``n`` ranges of equal size, read from the id column alone.

    Quantiles are doubles, which hold whole numbers up to 2**53 only. Of larger ids the 11 lowest bits are left out, so that any 64-bit ids are
    cut; a bound is then a multiple of 2048.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter("doc_id is not null")
    first, last = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    if first is None or n < 2:
        return []
    shift = 0 if max(abs(first), abs(last)) < 2**53 else 11
    found = ids.select(F.shiftright("doc_id", shift).cast("double").alias("at")).stat.approxQuantile("at", [k / n for k in range(1, n)], 0.1 / n)
    return sorted({int(b) << shift for b in found})


def kept_in_worker(name: str, key: object, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task. There is one: that of another name or key gives way first."""
    holder = sys.modules.setdefault("storyspark_worker", types.ModuleType("storyspark_worker"))
    found = getattr(holder, "kept", None)
    if found is None or found[0] != (name, key):
        holder.kept = found = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        holder.kept = found = ((name, key), make())
    return found[1]


#: Bytes of one Arrow batch; Spark's own default is eight times as much, of which a task holds several on either side of a Python worker.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Ask for Arrow batches of moderate size in this session, so that long texts don't fill executors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def slices(batch: pa.RecordBatch, text: str, rows: int = 500, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and, but for a longer text alone, ``size`` bytes of the column ``text``."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for k, length in enumerate(lengths):
        if k > start and (k - start == rows or total + length > size):
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += length
    if start < len(lengths):
        yield batch.slice(start)


def bounded_labels(labels: DataFrame, label: str, learn: Column, max_rows: int) -> DataFrame:
    """``(doc_id, label)`` of at most ``max_rows`` labelled documents for which ``learn`` holds.

    Rows without id or label are left out; a document with several labels has the largest. Above the bound the
    documents with the smallest hash stay, so that reruns take the same ones.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .filter(learn)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


#: Bits of an id filter and bytes of one chunk of it: 8 MB, whatever the number of ids.
FILTER_BITS, FILTER_CHUNK = 2**26, 2**13


def _places(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 26)


def id_filter(ids: DataFrame) -> Broadcast:
    """A bit map of fixed size that is set for every id of the one column of ``ids``, for :func:`may_hold`.

    It saves shuffles where few ids are wanted; where very many are, it lets more rows pass and changes nothing else.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7))).astype(np.uint8))
        for k, chunk in enumerate(bits.reshape(-1, FILTER_CHUNK)):
            if chunk.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk.tobytes()])], ["chunk", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([found.tobytes()])], ["chunk", "bits"])
                    at, found = row["chunk"], np.zeros(FILTER_CHUNK, np.uint8)
                found |= np.frombuffer(row["bits"], np.uint8)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([found.tobytes()])], ["chunk", "bits"])

    spark = ids.sparkSession
    marked = ids.filter(ids[ids.columns[0]].isNotNull()).mapInArrow(mark, "chunk int, bits binary")
    united = marked.repartition(partitions(spark), "chunk").sortWithinPartitions("chunk").mapInArrow(unite, "chunk int, bits binary")
    bits = np.zeros((FILTER_BITS // 8 // FILTER_CHUNK, FILTER_CHUNK), np.uint8)
    for row in united.collect():  # one row per chunk
        bits[row.chunk] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(bits.reshape(-1))


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """False where an id surely isn't in the filter."""
    at = _places(ids)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
