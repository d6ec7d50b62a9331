"""Token counts by heap-and-linked-list byte-pair merging (operator 9).

A pre-token starts as a list of byte symbols linked to their neighbours. A heap holds the adjacent pairs that have a
merge rank; the pair of lowest rank, leftmost first, is popped and merged while its symbols are still as they were
pushed. The count is the number of initial symbols minus the number of merges; no ids are made.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import kept_in_worker, slices
from storyspark.llm.pieces import Answers, byte_letters, keys, literal

#: Pieces and pre-tokens whose counts a Python worker keeps, about 150 bytes each.
KEPT_PIECES = 500_000
#: Fixed value: how a byte-level vocabulary without a pattern of its own cuts text before merging.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the symbols of one pre-token allow."""
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    alive = list(symbols)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if j < 0 or alive[i] != left or alive[j] != right:
            continue  # a neighbour was merged meanwhile
        alive[i], alive[j] = left + right, ""
        merges += 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (rank := ranks.get((alive[i], alive[k]))) is not None:
                heapq.heappush(heap, (rank, i, alive[i], alive[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get((alive[h], alive[i]))) is not None:
            heapq.heappush(heap, (rank, h, alive[h], alive[i]))
    return merges


class Counter:
    """Counts the tokens of a text under a byte-level BPE file."""

    def __init__(self, tokenizer_path: str) -> None:
        import regex

        with open(tokenizer_path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        if spec["normalizer"] or model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError(f"{tokenizer_path} is not a plain byte-level BPE vocabulary")
        self.ranks = {tuple(pair.split(" ") if isinstance(pair, str) else pair): rank for rank, pair in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.find = regex.compile(PRE_TOKENS).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.special = set(special)
        self.pre_tokens = Answers(self.pre_token, KEPT_PIECES)
        self.answers = Answers(lambda key: self.literal(literal(key)), KEPT_PIECES)

    def pre_token(self, text: str) -> int:
        symbols = list(text.encode().decode("latin-1").translate(self.letters))
        return len(symbols) - merge_count(symbols, self.ranks)

    def literal(self, text: str) -> int:
        """Special strings count as one token each, as the library has it by default."""
        if self.split is None:
            return sum(map(self.pre_tokens.__getitem__, self.find(text)))
        return sum(1 if part in self.special else sum(map(self.pre_tokens.__getitem__, self.find(part))) for part in self.split(text))

    def count(self, text: str) -> int:
        if not text:
            return 0
        head, rest = keys(text)
        body = sum(map(self.answers.__getitem__, rest))
        return body - 1 if head is None else self.literal(head) + body  # the added line end is a token of its own


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text of ``docs (doc_id, text)``, one row per row.

    Null and empty texts have 0 bytes and 0 tokens. ``over_limit`` is ``n_tokens > limit``. A null ``doc_id`` stays
    null, repeated rows are counted each, other columns are not used. No shuffle: texts are counted where they are read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_worker("counter", tokenizer_path, lambda: Counter(tokenizer_path))
        for batch in (part for whole in batches for part in slices(whole, "text")):
            tokens = pa.array(map(counter.count, batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), tokens], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sized = texts.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    counted = sized.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
