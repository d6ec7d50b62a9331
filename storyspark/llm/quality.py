"""Document quality by Bradley-Terry pairwise ranking (operator 7).

Each pair of a better and a worse document says that the first should be preferred. The worth of a document is a weighted
sum of its features, the chance that one is preferred is the logistic of the difference of worths, and the weights
minimise the logistic loss over feature differences. The cut between good and bad is a quantile of the worths.
"""

from __future__ import annotations

import operator
import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import slices

_UPPER, _LOWER, _DIGIT = (x.encode() for x in (string.ascii_uppercase, string.ascii_lowercase, string.digits))
_PLAIN_MARKS = b".,;:'\"()-"
_OTHER_MARKS = bytes(b for b in string.punctuation.encode() if b not in _PLAIN_MARKS)
FEATURES = (
    "log_words",
    "word_length",
    "distinct_share",
    "repeat_share",
    "upper_share",
    "digit_share",
    "plain_mark_share",
    "other_mark_share",
    "mark_word_share",
    "line_share",
)


def features(text: str) -> list[float]:
    """The values of :data:`FEATURES` for one text; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    without = lambda some: size - len(raw.translate(None, some))
    upper, lower = without(_UPPER), without(_LOWER)
    other = without(_OTHER_MARKS)
    return [
        float(np.log1p(n)),
        min(len(text) / n, 40.0),
        len(set(words)) / n,
        sum(map(operator.eq, words, islice(words, 1, None))) / n,
        upper / max(1, upper + lower),
        without(_DIGIT) / size,
        without(_PLAIN_MARKS) / size,
        other / size,
        min(1.0, other / n),
        text.count("\n") / n,
    ]


@dataclass(frozen=True)
class Ranking:
    """``score`` is the logistic of the worth, moved so that the quantile cut lies at ``cut_score``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    cut_score: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return _spread((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(self.cut_score / (1 - self.cut_score))
        return 1 / (1 + np.exp(-np.clip(self.worth(x) - self.cut + shift, -50, 50)))


def _spread(z: np.ndarray) -> np.ndarray:
    """Standardised features and their squares, both held within bounds."""
    z = np.clip(z, -8, 8)
    return np.concatenate([z, np.square(z) / 8], axis=1)


def _featured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``x``, the features of ``text``, instead of the text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            x = pa.array((features(t) for t in batch.column("text").to_pylist()), pa.list_(pa.float64()))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), x], [*kept, "x"])

    schema = ", ".join(f"{name} {kind}" for name, kind in docs.dtypes if name != "text")
    return docs.mapInArrow(compute, f"{schema}, x array<double>")


def fit(labelled: DataFrame, cut_score: float, max_pairs: int = 200_000, rounds: int = 400, seed: int = 11) -> Ranking:
    """Learn from a bounded sample ``labelled (text, label)``; the caller states the bound.

    Spark computes the features; the driver gets one short row per sampled document and draws at most ``max_pairs`` pairs
    of a document of label 1 and one of label 0. The cut is the quantile of all sampled worths at the share of label 0,
    in the middle between its neighbours. Null texts are empty. Without rows of both classes all weights are 0, and every score is
    ``cut_score`` if label 0 is absent or nothing is known, else just below.
    """
    rows = _featured(labelled.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int"))).collect()
    k = len(FEATURES)
    y = np.array([r.label for r in rows], int)
    if len(set(y.tolist())) < 2:
        return Ranking(np.zeros(k), np.ones(k), np.zeros(2 * k), 1e-6 if len(y) and not y.max() else 0.0, cut_score)
    x = np.array([r.x for r in rows], float)
    order = np.lexsort([*x.T, y])  # the rows' order must not matter
    x, y = x[order], y[order]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = _spread((x - mean) / scale)
    rng = np.random.default_rng(seed)
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n_pairs = min(max_pairs, len(better) * len(worse))
    a, b = rng.choice(better, n_pairs), rng.choice(worse, n_pairs)
    gap = z[a] - z[b]
    weights, speed, square = np.zeros(2 * k), np.zeros(2 * k), np.zeros(2 * k)
    for t in range(1, rounds + 1):  # Adam over all pairs
        slope = -(gap.T @ (1 / (1 + np.exp(np.clip(gap @ weights, -30, 30))))) / n_pairs + 1e-3 * weights
        speed, square = 0.9 * speed + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights = weights - 0.05 * (speed / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    worth = np.sort(z @ weights)
    at = len(worse)
    cut = (worth[at - 1] + worth[min(at, len(worth) - 1)]) / 2
    return Ranking(mean, scale, weights, float(cut), cut_score)


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``doc_id, score`` of every whole text of ``docs (doc_id, text)``, one row per row; 0 to 1, higher is better.

    Null and empty texts have all features 0 and get the score of those. Rows of one id are scored each, and a null id stays null. Other
    columns, whatever their names, are not read. An empty table gives no rows. A text of any length is read whole.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            x = np.array([features(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ranking.score(x))], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(judge, "doc_id bigint, score double")
