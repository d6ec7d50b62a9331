"""Ranked lexical search without random access (operator 11).

1. *Postings.* One scan finds, for every document, its number of terms and the frequencies of the terms that a query has. Queries
   are taken in blocks of bounded size, so that the terms sent to all tasks are bounded too.
2. *Statistics.* Document frequencies, the number of documents and of terms are Spark aggregates over all documents.
3. *NRA.* Each task cuts its documents into shards of bounded size and lists, for every query term, the postings of a shard by falling
   impact. A query reads its lists from the top, in turns. What a document has been seen with is its lower bound; with the impact at
   which each list where it has not been seen stands now, its upper bound. Reading goes on while a document that
   may still belong to the best has an open interval, or one that has not been seen at all could: then members, ties and
   scores are exact. The task's best documents so far are the bar for its next shard.
4. The best of all tasks are ranked per query; tasks send no more than ``k`` documents for each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.session import stage

#: Bytes of query texts in one block.
BLOCK_BYTES = 8_000_000
#: Postings and documents of one shard: what a task holds beside the lists' first reads.
SHARD_POSTINGS, SHARD_DOCS = 2_000_000, 16_384
#: Postings that a query reads from each list at first; every turn doubles that.
FIRST_READ = 64
#: Term characters are ASCII letters and digits and everything beyond ASCII, in UTF-8 all bytes from 128; A-Z become small, the rest ends a term.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() and not chr(b).isupper() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_FOLD).split()


def _frequencies(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every text with at least one term; ``terms`` are places in the vocabulary."""
    places = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(places.value)}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sizes, found, tfs = [], [], []
                for text in part.column(1):
                    every = terms(text.as_py())
                    known = np.array([p for p in map(place.get, every) if p is not None], np.int32)
                    which, how_often = np.unique(known, return_counts=True)
                    sizes.append(len(every))
                    found.append(which)
                    tfs.append(how_often.astype(np.int32))
                out = [part.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tfs array<int>").filter("n > 0")


@dataclass(frozen=True)
class Statistics:
    """Of all documents: those with a term, their terms with repeats, and the weight of each term of the vocabulary."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    def impacts(self, places: np.ndarray, tfs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What one query occurrence of a term adds to the score of a document."""
        m = 100 - 75 + (75 * sizes * self.n_docs) // max(self.n_terms, 1)
        return self.weights[places] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))


def _statistics(frequencies: DataFrame, size: int) -> Statistics:
    """The counts come back as one number per term of the vocabulary, whose size the block of queries bounds."""
    n_docs, n_terms = frequencies.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.full(size, math.floor(1000 * math.log(2 * n_docs + 2)), np.int64)
    for row in frequencies.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        weights[row.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))
    return Statistics(n_docs, n_terms, weights)


class Shard:
    """Impact-sorted lists over some documents."""

    def __init__(self, ids: list[int | None], places: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> None:
        order = np.lexsort((docs, -impacts, places))
        self.ids, self.docs, self.impacts = ids, docs[order], impacts[order]
        starts = np.flatnonzero(np.diff(places[order], prepend=-1))
        ends = np.append(starts[1:], len(order))
        self.lists = {int(p): (int(a), int(b)) for p, a, b in zip(places[order][starts], starts, ends, strict=True)}

    def best(self, query: dict[int, int], k: int, bar: list[int], first_read: int = FIRST_READ) -> list[tuple[int, int]]:
        """``(score, document)`` of all documents that may be among the best ``k`` together with the scores in ``bar``, exact.

        ``query`` has the number of occurrences by term. Documents that score less than the ``k``-th best, and those that score nothing, are left out.
        """
        lists = [(*self.lists[p], times) for p, times in query.items() if p in self.lists]
        if not lists:
            return []
        low = np.zeros(len(self.ids), np.int64)
        seen = np.zeros((len(lists), len(self.ids)), bool)
        at = [a for a, _, _ in lists]
        # The impact that the next posting of each list cannot pass; 0 behind its end.
        frontier = np.array([self.impacts[a] * times for a, _, times in lists], np.int64)
        read = first_read
        while True:
            for i, (_, end, times) in enumerate(lists):
                stop = min(at[i] + read, end)
                if at[i] < stop:
                    docs = self.docs[at[i] : stop]  # a document comes once in a list
                    low[docs] += self.impacts[at[i] : stop] * times
                    seen[i, docs] = True
                    at[i] = stop
                    frontier[i] = self.impacts[stop] * times if stop < end else 0
            read *= 2
            least = self._least(low, k, bar)
            high = low + frontier.sum() - frontier @ seen
            open_ones = (high > low) & (high >= least) & (high > 0)
            if not open_ones.any():
                members = np.flatnonzero((low >= least) & (low > 0))
                return [(int(low[d]), int(d)) for d in members]

    @staticmethod
    def _least(low: np.ndarray, k: int, bar: list[int]) -> int:
        """The ``k``-th highest lower bound, those of earlier shards included; 0 if there are fewer."""
        top = np.partition(low, len(low) - k)[len(low) - k :] if len(low) > k else low
        known = np.sort(np.concatenate([top, np.array(bar, np.int64)]))[::-1]
        return int(known[k - 1]) if len(known) >= k else 0


def _search(frequencies: DataFrame, statistics: Statistics, queries: list[dict[int, int]], k: int) -> DataFrame:
    """``query, doc_id, score``: at most ``k`` documents of each task for each query."""
    shared = frequencies.sparkSession.sparkContext.broadcast((statistics, queries))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics, queries = shared.value
        best: list[list[tuple[int, int | None]]] = [[] for _ in queries]

        def look(waiting: list[pa.RecordBatch]) -> None:
            ids, sizes, places, tfs, counts = [], [], [], [], []
            for b in waiting:
                ids += b.column(0).to_pylist()
                sizes.append(b.column(1).to_numpy())
                counts.append(np.diff(b.column(2).offsets.to_numpy()))
                places.append(b.column(2).flatten().to_numpy())
                tfs.append(b.column(3).flatten().to_numpy())
            counts, places, tfs = np.concatenate(counts), np.concatenate(places), np.concatenate(tfs).astype(np.int64)
            docs = np.repeat(np.arange(len(ids)), counts)
            shard = Shard(ids, places, docs, statistics.impacts(places, tfs, np.repeat(np.concatenate(sizes), counts)))
            for q, query in enumerate(queries):
                found = [(score, ids[d]) for score, d in shard.best(query, k, [s for s, _ in best[q]])]
                if found:
                    best[q] = sorted(best[q] + found, key=_rank)[:k]

        waiting, docs, postings = [], 0, 0
        for batch in batches:
            for part in _slices(batch):
                size = len(part.column(2).flatten())
                if waiting and (docs + part.num_rows > SHARD_DOCS or postings + size > SHARD_POSTINGS):
                    look(waiting)
                    waiting, docs, postings = [], 0, 0
                waiting.append(part)
                docs, postings = docs + part.num_rows, postings + size
        if waiting:
            look(waiting)
        rows = [(q, doc_id, score) for q, found in enumerate(best) for score, doc_id in found]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["query", "doc_id", "score"])

    return frequencies.mapInArrow(search, "query int, doc_id bigint, score bigint")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, 512):
        yield batch.slice(start, 512)


def _rank(found: tuple[int, int | None]) -> tuple:
    score, doc_id = found
    return -score, doc_id is None, doc_id or 0


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of ``docs (doc_id, text)`` for each row of ``items (item_id, text)``.

    With N documents that have a term, L terms in them, n in one of them and df documents that hold a term, a term weighs
    ``floor(1000 * ln((2N + 2) / (2 df + 1)))``, and tf occurrences of it add that times ``10**9 tf div (1000 tf + 8 m)`` for every occurrence in the
    item, where ``m = 25 + 75 n N div L``. Only scores above 0 count; equal ones go by ascending ``doc_id``, null last. Every row is a
    document, and every row of ``items`` an item, also where ids are null or repeated. Null and empty texts have no terms: such documents
    are not counted, such items have no rows, nor have items of an empty table of documents. Other columns are not used.
    """
    spark = docs.sparkSession
    known = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    dealt = known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    item_type = items.schema["item_id"].dataType
    every = None
    for b in range(blocks):
        rows = dealt.filter(F.col("block") == b).select("item_id", "text").collect()  # about block_bytes
        listed = [terms(r.text.encode("utf-8", "surrogatepass")) for r in rows]
        vocabulary = sorted(set().union(*listed))
        place = {t: i for i, t in enumerate(vocabulary)}
        queries = [{place[t]: times for t, times in Counter(words).items()} for words in listed]
        frequencies = stage(_frequencies(docs, vocabulary), "search-postings")
        found = _search(frequencies, _statistics(frequencies, len(vocabulary)), queries, k)
        best = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", item_type)]))
        best = best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        every = best if every is None else every.unionByName(best)
    return every
