"""Benchmark decontamination by SimHash of item-sized windows (operator 6). Native expressions only.

Documents and benchmark items are word lists, lower-cased, and five-word shingles are hashed to 64 bits. A window has as many
words as an item, at any offset at which it holds a shingle of such an item: the others have similarity 0. Only windows that can
reach the similarity are made: what a window shares with an item is at most the running sum of the weights of its shingles that any item of
this size has, and must be that part of the lightest such item's weight. Equal windows are looked at once, wherever they occur.

Windows and items get weighted SimHash fingerprints. Two fingerprints within ``radius`` bits agree in at least one of ``radius + 1``
blocks, so joining on the size and each block finds all of them. What is within the radius is verified by the exact
weighted Jaccard similarity of the shingle sets; a shingle weighs one over the number of items that have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyspark.operators.hotkeys import rows_among
from storyspark.session import stage

SHINGLE = 5
SIMILARITY = 0.8
#: Two sets of similarity 0.8 differ in 10 of 64 bits on average, with a deviation of 3.
RADIUS = 20
#: Up to this many shingles of the benchmark are sent to all tasks, about 50 MB; beyond it documents are shuffled by shingle.
BROADCAST_ROWS = 1_000_000
#: By so much a running sum may miss its bound: similarities are rounded to 6 digits, and sums of doubles have an error.
SLACK = 1e-5


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingle(words: Column, position: Column) -> Column:
    """The hash of five words, or of what there is of them: null elements don't enter it."""
    return F.xxhash64(*(F.get(words, position + k) for k in range(SHINGLE)))


def _shingles(words: Column) -> Column:
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    return F.when(F.size(words) > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda p: _shingle(words, p)))).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, fingerprint`` from one row per key and shingle ``(shingle, weight)``."""
    bits = [F.sum(F.when(F.shiftright("shingle", b).bitwiseAND(1) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}") for b in range(64)]
    summed = weighted.groupBy(*keys).agg(*bits)
    joined = None
    for b in range(64):
        bit = F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("bigint")
        joined = bit if joined is None else joined.bitwiseOR(bit)
    return summed.select(*keys, joined.alias("fingerprint"))


def _blocks(fingerprint: Column, radius: int) -> Column:
    """``(block, value)`` for each of ``radius + 1`` blocks that together have all 64 bits."""
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    return F.array(
        *(
            F.struct(F.lit(k).alias("block"), F.shiftright(fingerprint, a).bitwiseAND((1 << (b - a)) - 1).alias("value"))
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        )
    )


def _windows(docs: DataFrame, anchors: DataFrame, similarity: float) -> DataFrame:
    """``doc_id, n_words, window``: the words of every window that can reach ``similarity``, possibly several times.

    ``anchors (n_words, shingle, weight, least)`` has the shingles of the items by size, and the least weight of an item of that size.
    """
    slots = F.greatest(F.col("n_words") - SHINGLE, F.lit(0)) + 1  # shingles of a window
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("text_id", F.xxhash64("text"))
    listed = texts.select("doc_id", "text_id", word_list(F.col("text")).alias("words"))
    # With the outer form no filter on the number of words is made, which would split every text a second time.
    spread = listed.select("doc_id", "text_id", "words", F.posexplode_outer("words").alias("position", "_word"))
    spread = spread.filter(F.col("position") <= F.greatest(F.size("words") - SHINGLE, F.lit(0)))
    # Positions go on without the words of their text: a row is small however long the text is.
    places = spread.select("doc_id", "text_id", F.size("words").alias("n_text"), "position", _shingle(F.col("words"), F.col("position")).alias("shingle"))
    hits = places.join(anchors, "shingle").select("doc_id", "text_id", "n_text", "n_words", "position", "weight", "least").distinct()
    hits = stage(hits, "bench-hits")

    text = ["doc_id", "text_id", "n_words"]
    top = F.col("n_text") - F.col("n_words")
    first, last = F.greatest(F.least(F.col("position") - slots + 1, top), F.lit(0)), F.greatest(F.least(F.col("position"), top), F.lit(0))
    steps = hits.select(
        *text,
        "least",
        F.inline(F.array(F.struct(first.alias("start"), F.col("weight").alias("step")), F.struct((last + 1).alias("start"), (-F.col("weight")).alias("step")))),
    )
    steps = steps.groupBy(*text, "least", "start").agg(F.sum("step").alias("step"))
    order = Window.partitionBy(*text).orderBy("start")
    sums = steps.select(*text, "least", "start", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("shared"), F.lead("start").over(order).alias("next"))
    able = sums.filter(F.col("next").isNotNull() & (F.col("shared") >= (similarity - SLACK) * F.col("least")))
    runs = able.groupBy(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text")).agg(F.collect_list(F.struct("n_words", "start", (F.col("next") - 1).alias("last"))).alias("runs"))
    runs = stage(runs, "bench-runs")

    # Only texts with such a run are read and split again, each once for all its windows.
    again = rows_among(texts, "doc_id", runs.select(F.col("_id").alias("doc_id"))).join(runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_id") == F.col("_text")))
    again = again.select("doc_id", word_list(F.col("text")).alias("words"), "runs").select("doc_id", "words", F.explode_outer("runs").alias("run"))
    starts = again.select("doc_id", "words", F.col("run.n_words").alias("n_words"), F.explode_outer(F.sequence("run.start", "run.last")).alias("start"))
    return starts.select("doc_id", "n_words", F.slice("words", F.col("start") + 1, F.col("n_words")).alias("window"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``doc_id, item_id, similarity``: documents with a window like a benchmark item, with the best window's similarity.

    ``docs (doc_id, text)`` and ``benchmark (item_id, text)`` may have other columns. An item of fewer than five words is one shingle and is
    found only where a document has no other words. Null and empty texts and items match nothing; rows of one ``doc_id`` count as
    one, and so do items of one ``item_id`` and size, null ids as one each. A document shorter than an item is one window. One row per pair, similarity to 6 digits.
    """
    items = stage(
        benchmark.select(F.col("item_id"), word_list(F.col("text")).alias("words"))
        .select("item_id", F.size("words").alias("n_words"), "words", _shingles(F.col("words")).alias("shingles"))
        .filter("n_words > 0"),
        "benchmark-items",
    )
    weights = items.select("item_id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg((1.0 / F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("weight"))
    weights = stage(weights, "benchmark-weights")
    item_rows = items.select("item_id", "n_words", F.explode("shingles").alias("shingle")).distinct().join(weights, "shingle")
    item_rows = stage(item_rows, "benchmark-shingles")
    item_sums = item_rows.groupBy(F.col("item_id").alias("_item"), F.col("n_words").alias("_n")).agg(F.sum("weight").alias("item_weight"))
    least = item_sums.groupBy(F.col("_n").alias("n_words")).agg(F.min("item_weight").alias("least"))
    anchors = stage(item_rows.select("n_words", "shingle", "weight").distinct().join(least, "n_words"), "benchmark-anchors")
    small = anchors.count() <= BROADCAST_ROWS
    windows = _windows(docs, F.broadcast(anchors) if small else anchors, similarity)
    places = stage(windows.select("doc_id", "n_words", "window", F.xxhash64(F.array_join("window", " ")).alias("window_id")).dropDuplicates(["doc_id", "n_words", "window_id"]), "bench-windows")
    contents = places.groupBy("n_words", "window_id").agg(F.first("window").alias("window")).select("n_words", "window_id", _shingles(F.col("window")).alias("shingles"))
    contents = stage(contents, "bench-contents")

    # The rows of a window stay together, or are brought together, so that a task sums the 64 bits of a window once and not in many parts.
    spread = contents.select("n_words", "window_id", F.explode("shingles").alias("shingle")).join(F.broadcast(weights) if small else weights, "shingle", "left")
    window_rows = spread.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    window_rows = stage(window_rows if small else window_rows.repartition("n_words", "window_id"), "bench-shingles")
    window_prints = _fingerprints(window_rows, ["n_words", "window_id"])
    item_prints = _fingerprints(item_rows, ["item_id", "n_words"])
    left = window_prints.select("n_words", "window_id", "fingerprint", F.inline(_blocks(F.col("fingerprint"), radius)))
    right = item_prints.select("n_words", "item_id", F.col("fingerprint").alias("item_fingerprint"), F.inline(_blocks(F.col("fingerprint"), radius)))
    near = left.join(right, ["n_words", "block", "value"]).filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= radius)
    candidates = stage(near.select("n_words", "window_id", "item_id").distinct(), "bench-candidates")

    window_sums = window_rows.groupBy("n_words", "window_id").agg(F.sum("weight").alias("window_weight"))
    pairs = candidates.join(window_rows, ["n_words", "window_id"])
    inside = item_rows.select(F.col("item_id").alias("_item"), F.col("n_words").alias("_n"), F.col("shingle").alias("_shingle"))
    same = pairs["item_id"].eqNullSafe(inside["_item"]) & (pairs["n_words"] == inside["_n"]) & (pairs["shingle"] == inside["_shingle"])
    common = pairs.join(inside, same).groupBy("n_words", "window_id", "item_id").agg(F.sum("weight").alias("common"))
    of_item = F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("n_words") == F.col("_n"))
    scored = common.join(window_sums, ["n_words", "window_id"]).join(item_sums, of_item)
    scored = scored.withColumn("similarity", F.round(F.col("common") / (F.col("window_weight") + F.col("item_weight") - F.col("common")), 6))
    verified = scored.filter(F.col("similarity") >= similarity).select("n_words", "window_id", "item_id", "similarity")
    found = places.select("doc_id", "n_words", "window_id").join(verified, ["n_words", "window_id"])
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def without_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which an item was found; rows of one id go together."""
    found = find_contamination(docs, benchmark).select(F.col("doc_id").alias("_id")).distinct()
    found = stage(found, "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left_anti")
