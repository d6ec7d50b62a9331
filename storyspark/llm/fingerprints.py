"""Document fingerprints by a homomorphic multiset hash (operator 3).

A paragraph, that is a line that isn't blank, is hashed to a wide vector, and the fingerprint of a document is the sum of the
vectors of its paragraphs, each lane modulo 2**32. The order of paragraphs doesn't matter, and a paragraph is inserted or deleted by
adding or subtracting its vector (:func:`inserted`, :func:`deleted`).

The first lanes are a cryptographic hash of the whole paragraph; they decide equality. The others hold signed counts of
the paragraph's runs of characters, each hashed to one lane and one sign, so that they add up like the first but stay
alike when most of a paragraph stays: the cosine of two documents' counts is their likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import id_bounds, partitions

EQUAL_LANES, LIKE_LANES = 16, 160
LANES = EQUAL_LANES + LIKE_LANES
#: Characters in a run; a shorter paragraph is one run.
RUN = 12
_BLOCK = 2**16
_BASE, _MIX_1, _MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S32, _S29, _ONE = np.uint64(32), np.uint64(29), np.uint64(1)


def _lanes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lane and sign of each hash."""
    h = (h ^ (h >> _S32)) * _MIX_1
    h = (h ^ (h >> _S29)) * _MIX_2
    h ^= h >> _S32
    return (((h >> _S32) * np.uint64(LIKE_LANES)) >> _S32).astype(np.int64), ((h & _ONE).astype(np.float64) * 2 - 1)


def vectors(texts: list[str]) -> np.ndarray:
    """The fingerprints of texts as rows of unsigned 32-bit lanes; memory beside the texts doesn't grow with a text."""
    n = len(texts)
    like = np.zeros(n * LIKE_LANES)
    equal = np.zeros((n, EQUAL_LANES), np.uint32)
    short: list[tuple[int, int]] = []
    for k, text in enumerate(texts):
        for line in text.split("\n"):
            if line and not line.isspace():
                digest = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=4 * EQUAL_LANES).digest()
                equal[k] += np.frombuffer(digest, "<u4")
                if len(line) < RUN:
                    short.append((k, int.from_bytes(digest[:8], "little")))
    if short:
        lane, sign = _lanes(np.array([h for _, h in short], np.uint64))
        np.add.at(like, np.array([k for k, _ in short]) * LIKE_LANES + lane, sign)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    owners = np.repeat(np.arange(n, dtype=np.int32), [len(t) + 1 for t in texts])
    for start in range(0, len(codes), _BLOCK):
        some = codes[start : start + _BLOCK + RUN - 1].astype(np.uint64)
        size = len(some) - RUN + 1
        if size <= 0:
            break
        ends = np.concatenate([[0], np.cumsum(some == 10)])
        whole = ends[RUN : RUN + size] == ends[:size]  # runs within one line
        h = some[:size].copy()
        for j in range(1, RUN):
            h *= _BASE
            h += some[j : j + size]
        lane, sign = _lanes(h[whole])
        own = owners[start : start + size][whole].astype(np.int64)
        if len(own):
            first = int(own[0])
            sums = np.bincount((own - first) * LIKE_LANES + lane, sign)
            like[first * LIKE_LANES : first * LIKE_LANES + len(sums)] += sums
    return np.concatenate([equal, like.reshape(n, LIKE_LANES).astype(np.int64).astype(np.uint32)], axis=1)


def inserted(vector: np.ndarray, paragraph: str) -> np.ndarray:
    """The fingerprint after a paragraph came in."""
    return vector + vectors([paragraph])[0]


def deleted(vector: np.ndarray, paragraph: str) -> np.ndarray:
    """The fingerprint after a paragraph went out."""
    return vector - vectors([paragraph])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of rows: 1 if the equality lanes agree, else the cosine of the counts, at least 0."""
    same = (a[:, :EQUAL_LANES] == b[:, :EQUAL_LANES]).all(axis=1)
    x, y = (v[:, EQUAL_LANES:].astype(np.int32).astype(np.float64) for v in (a, b))
    length = np.sqrt(np.square(x).sum(1) * np.square(y).sum(1))
    cosine = np.clip((x * y).sum(1) / np.maximum(length, 1e-9), 0, 1)
    return np.where(same, 1.0, cosine)


def as_text(vector: np.ndarray) -> str:
    """The lanes as little-endian bytes in base 64."""
    return base64.b64encode(vector.astype("<u4").tobytes()).decode()


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds are at least ``doc_id``; looked up in blocks, so a row costs the square root."""
    block = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[k : k + block] for k in range(0, len(bounds), block)]
    firsts = F.array(*(F.lit(b[0]) for b in blocks))
    at = F.size(F.filter(firsts, lambda x: x >= doc_id))
    inside = F.element_at(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), F.greatest(at, F.lit(1)))
    return (F.greatest(at - 1, F.lit(0)) * block + F.size(F.filter(inside, lambda x: x >= doc_id))).cast("int")


def with_next(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Rows in descending order of ``doc_id`` dealt to buckets, each bucket followed by the first row of the next.

    ``bucket, guest, doc_id, text``, sorted within partitions; ``guest`` marks the rows that only end a bucket. Bounds
    are the largest ids of ranges, found on the id column alone, so each bucket's first document is known from its id. Null ids
    come last; rows of one id, by a hash of their text and their text, stay in one bucket. Texts move once.
    """
    cuts = sorted(id_bounds(docs, n_buckets), reverse=True) or [0]
    known = docs.filter("doc_id is not null").groupBy(_bucket(F.col("doc_id"), cuts).alias("bucket")).agg(F.max("doc_id").alias("first"))
    firsts = sorted((r[0] for r in known.select("first").collect()), reverse=True)  # one number per range
    last = firsts[0] if firsts else None
    bounds = firsts or [0]
    own = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(_bucket(F.col("doc_id"), bounds))
    placed = docs.select(own.alias("bucket"), "doc_id", "text")
    #: The first document of a bucket also ends the one before; the very first one ends the last bucket.
    head = F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket")) == F.col("doc_id")
    before = F.when(F.col("bucket") == 1, F.lit(len(bounds))).otherwise(F.col("bucket") - 1)
    if last is None:  # only null ids: one bucket, ended by its own first row
        head, before = F.lit(True), F.lit(len(bounds))
    places = F.when(head, F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.struct(before.cast("int").alias("bucket"), F.lit(1).alias("guest")))).otherwise(
        F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")))
    )
    return (
        placed.select(F.inline(places), "doc_id", "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartition(partitions(docs.sparkSession), "bucket")
        .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "tie", "text")
        .select("bucket", "guest", "doc_id", "text")
    )


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Fingerprints of every whole text of ``docs (doc_id, text)`` and of its edited text, one row per row.

    In the edited text the last third of the code points (rounded down) gives way to as many first ones, or all, of the next document by
    descending id; the first follows the last, and a single document follows itself. ``near_edited`` and ``near_next``
    compare the fingerprint with that of the edited text and of the next document. Null texts are empty; an empty
    text has a fingerprint of zeros. Order of equal and null ids: see :func:`with_next`. Other columns are not used.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = with_next(texts, n_buckets or 3 * partitions(docs.sparkSession))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last row so far: bucket, guest, doc_id, text, vector
        for batch in batches:
            for rows in _slices(batch):
                own = vectors([r[3] for r in rows])
                chain = ([waiting] if waiting else []) + [(*r, v) for r, v in zip(rows, own, strict=True)]
                pairs = [(a, b) for a, b in zip(chain, chain[1:], strict=False) if a[0] == b[0] and not a[1]]
                waiting = chain[-1]
                if pairs:
                    yield _compared(pairs)

    return ordered.mapInArrow(compute, _RESULT)


def _slices(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Rows of a batch in lists of at most 200 rows and, but for single long texts, a million characters."""
    rows, size = [], 0
    for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
        if rows and (len(rows) == 200 or size + len(row[3]) > 1_000_000):
            yield rows
            rows, size = [], 0
        rows.append(row)
        size += len(row[3])
    if rows:
        yield rows


def _compared(pairs: list[tuple[tuple, tuple]]) -> pa.RecordBatch:
    edited = []
    for (_, _, _, text, _), (_, _, _, following, _) in pairs:
        cut = len(text) // 3
        edited.append(text[: len(text) - cut] + following[:cut])
    mine, theirs, changed = np.array([a[4] for a, _ in pairs]), np.array([b[4] for _, b in pairs]), vectors(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[2] for a, _ in pairs], pa.int64()),
            pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array([as_text(v) for v in mine]),
            pa.array([as_text(v) for v in changed]),
            pa.array(likeness(mine, changed)),
            pa.array(likeness(mine, theirs)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
