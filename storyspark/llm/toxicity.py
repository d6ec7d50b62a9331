"""Toxicity by a factorization machine over hashed terms (operator 2).

Terms of a text are its lower-cased words and their first four and five letters, so that inflected forms are met too,
each hashed to a bucket and counted as present or not. On a bounded labelled sample two kinds of buckets are selected: those
that tell the classes apart alone, and the members of pairs that tell more, or the contrary, together than each of them alone, whatever
they do by themselves. A factorization machine is fitted over them by logistic loss: a bias, one weight per bucket, and one short factor
vector per bucket whose inner products weigh pairs of terms, such as an insult with a group name, that no sum of single weights can express.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import kept_in_worker, slices
from storyspark.llm.pieces import Answers
from storyspark.session import stage

BUCKETS = 2**20
#: A bucket is selected only if its rate differs by this many standard errors.
LEAST_Z = 3.5
#: A pair is selected only if its rate lies outside those of its two members by this many standard errors, in at least so many texts.
LEAST_PAIR_Z, LEAST_PAIR_TEXTS = 6.0, 10
_WORD = re.compile(r"\w+")
#: Pieces of text whose buckets a Python worker keeps.
KEPT_PIECES = 200_000


def piece_terms(piece: str) -> tuple[int, ...]:
    """Buckets of the terms of a piece of lower-case text."""
    terms = set()
    for word in _WORD.findall(piece):
        for term in (word, f"4 {word[:4]}", f"5 {word[:5]}"):
            terms.add(zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS)
    return tuple(terms)


@dataclass(frozen=True)
class FactorizationMachine:
    """``buckets`` are ascending; row ``i`` of ``weights`` and ``factors`` belongs to ``buckets[i]``."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, present: list[np.ndarray]) -> np.ndarray:
        """Log-odds of documents given as the rows (of the selected buckets) that they hold."""
        out = np.full(len(present), self.bias)
        for k, rows in enumerate(present):
            if len(rows):
                v = self.factors[rows]
                out[k] += self.weights[rows].sum() + 0.5 * (np.square(v.sum(0)).sum() - np.square(v).sum())
        return out


def _answers(place: dict[int, int] | None) -> Answers:
    return Answers(lambda p: piece_terms(p) if place is None else tuple(place[t] for t in piece_terms(p) if t in place), KEPT_PIECES)


def _terms(text: str | None, answers: Answers) -> set[int]:
    return set().union(*map(answers.__getitem__, set(text.lower().split()))) if text else set()


def _present(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """``docs`` with ``terms``: the distinct buckets of each text, or the positions in ``wanted`` of those among them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None if wanted is None else {int(b): i for i, b in enumerate(wanted)}
        terms = kept_in_worker("toxic_terms", None if wanted is None else wanted.tobytes(), lambda: _answers(place))
        for batch in (part for whole in batches for part in slices(whole, "text")):
            text = batch.column("text").to_pylist()
            found = pa.array((sorted(_terms(t, terms)) for t in text), pa.list_(pa.int32()))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], [*kept, "terms"])

    schema = ", ".join(f"{name} {kind}" for name, kind in docs.dtypes if name != "text")
    return docs.mapInArrow(find, f"{schema}, terms array<int>")


def pair_members(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each column of 0 and 1 belongs to a pair of which both together say more, or the contrary, than either member says alone."""
    share = y.mean()
    n, positive = x.sum(0, dtype=np.float64), x[y == 1].sum(0, dtype=np.float64)
    rate = ((positive + share) / (n + 1)).astype(np.float32)
    best = np.zeros(x.shape[1])
    for start in range(0, x.shape[1], 256):
        some = slice(start, start + 256)
        both, both_positive = np.zeros((2, len(rate[some]), x.shape[1]), np.float32)
        for first in range(0, len(x), 1000):  # a bounded part of the matrix as numbers that can be multiplied fast
            part, label = x[first : first + 1000].astype(np.float32), y[first : first + 1000] == 1
            both += part[:, some].T @ part
            both_positive += part[label][:, some].T @ part[label]
        high, low = np.maximum(rate[some, None], rate[None]), np.minimum(rate[some, None], rate[None])
        more = (both_positive - both * high) / np.sqrt(both * high * (1 - high) + 1)
        less = (both * low - both_positive) / np.sqrt(both * low * (1 - low) + 1)
        z = np.where(both >= LEAST_PAIR_TEXTS, np.maximum(more, less), 0)
        z[np.arange(len(z)), start + np.arange(len(z))] = 0
        best[some] = z.max(1, initial=0)
    return best >= LEAST_PAIR_Z


def _matrix(terms: pa.ListArray, buckets: np.ndarray) -> np.ndarray:
    """One row per text and one column per bucket, 1 where the text holds it."""
    x = np.zeros((len(terms), len(buckets)), np.uint8)
    held = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
    every = terms.flatten().to_numpy()
    at = np.minimum(np.searchsorted(buckets, every), len(buckets) - 1)
    known = buckets[at] == every
    x[held[known], at[known]] = 1
    return x


def fit(
    labelled: DataFrame, max_terms: int = 2_000, max_pair_terms: int = 2_048, n_factors: int = 4, epochs: int = 30, seed: int = 7
) -> FactorizationMachine:
    """Fit on a bounded sample ``labelled (text, label)``, label 0 or 1; the caller states the bound.

    Term counts by class are Spark aggregates; the driver gets, for each sampled row, which of at most ``max_terms`` buckets that
    count alone and of the ``max_pair_terms`` most frequent ones, among which pairs are sought, it holds. Null and empty texts have no terms.
    Without rows of both classes the machine is a bias alone: the share of label 1, or one half if there are no rows.
    """
    rows = stage(_present(labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int")), None), "toxic-terms")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = float(np.clip(positive / n if n else 0.5, 0.01, 0.99))
    nothing = FactorizationMachine(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, n_factors)))
    if not 0 < positive < n:
        return nothing
    counts = rows.select("label", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    # Chi-square of presence against the label, in its normal form.
    expected = F.col("n") * share
    z = F.abs(F.col("p") - expected) / F.sqrt(expected * (1 - share) * (1 - F.col("n") / F.lit(float(n))) + 1)
    counts = stage(counts, "toxic-counts")
    alone = counts.filter((F.col("n") >= 3) & (z >= LEAST_Z)).orderBy(z.desc(), "bucket").limit(max_terms).select("bucket")
    common = counts.filter((F.col("n") >= LEAST_PAIR_TEXTS) & (F.col("n") <= 0.9 * n)).orderBy(F.desc("n"), "bucket").limit(max_pair_terms).select("bucket")
    alone, common = (np.array(sorted(r.bucket for r in f.collect()), np.int64) for f in (alone, common))
    every = np.union1d(alone, common)
    if not len(every):
        return nothing
    among = F.split(F.lit(",".join(map(str, every))), ",").cast("array<int>")
    sample = rows.select("label", F.array_intersect("terms", among).alias("terms")).toArrow().combine_chunks()
    y, terms = sample.column("label").to_numpy().astype(float), sample.column("terms").combine_chunks()
    if len(common):
        common = common[pair_members(_matrix(terms, common), y)]
    buckets = np.union1d(alone, common)
    if not len(buckets):
        return nothing
    return _descend(_matrix(terms, buckets).astype(np.float32), y, nothing.bias, buckets, n_factors, epochs, seed)


def _descend(x: np.ndarray, y: np.ndarray, bias: float, buckets: np.ndarray, n_factors: int, epochs: int, seed: int) -> FactorizationMachine:
    """Adam over mini-batches of the logistic loss with a small quadratic penalty."""
    rng = np.random.default_rng(seed)
    theta = [np.array([bias]), np.zeros(x.shape[1]), rng.normal(0, 0.01, (x.shape[1], n_factors))]
    first, second, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    penalty, rate, size = (0.0, 2e-4, 1e-3), 0.02, 256
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // size)):
            b, w, v = theta
            xb = x[rows].astype(float)
            xv = xb @ v
            margin = b[0] + xb @ w + 0.5 * (np.square(xv).sum(1) - xb @ np.square(v).sum(1))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            xe = xb.T @ error
            slopes = [np.array([error.sum()]), xe, xb.T @ (error[:, None] * xv) - xe[:, None] * v]
            step += 1
            for k, slope in enumerate(slopes):
                slope = slope + penalty[k] * theta[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                theta[k] = theta[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(float(theta[0][0]), buckets, theta[1], theta[2])


def score(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """``doc_id, score`` of every whole text of ``docs (doc_id, text)``, one row per row; 0 to 1, higher is likelier toxic.

    Null and empty texts get the score of the bias. Equal texts get equal scores, whatever their ids; rows of one id are scored each, and a
    null id stays null. Other columns, whatever their names, are not read. An empty table gives no rows. A text of any length is read whole.
    """

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = batch.column("terms")
            present = [np.asarray(x, int) for x in terms.to_pylist()]
            odds = machine.margin(present)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(odds, -50, 50))))], ["doc_id", "score"])

    return _present(texts, machine.buckets).mapInArrow(judge, "doc_id bigint, score double")


def keep_below(docs: DataFrame, machine: FactorizationMachine, cut: float) -> DataFrame:
    """The rows of ``docs`` whose whole text scores below ``cut``, with all their columns, where they are read."""
    place = {int(b): i for i, b in enumerate(machine.buckets)}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = kept_in_worker("toxic_terms", machine.buckets.tobytes(), lambda: _answers(place))
        for batch in (part for whole in batches for part in slices(whole, "text")):
            present = [np.array(sorted(_terms(text, terms)), int) for text in batch.column("text").to_pylist()]
            odds = machine.margin(present)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(odds, -50, 50))) < cut))

    return docs.mapInArrow(keep, docs.schema)
