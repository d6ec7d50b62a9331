"""BM25 search with many queries at once: an inverted index in blocks of documents, of which a query scores only those that can matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.functions import text as X
from storyspark.session import stage

#: Documents in one block, on average.
BLOCK_DOCS = 1024
#: Blocks that every query scores first; the k-th best of them is the bar for all others.
FIRST_BLOCKS = 2
#: Bounds are sums of doubles in any order; scores are compared after rounding to six digits.
_SLACK = 1e-5
#: Terms of queries, and blocks chosen by queries, that are sent to where the postings lie; more of them meet postings by a shuffle.
SENT_ROWS = 1_000_000


def postings(docs: DataFrame, terms: DataFrame, n_blocks: int, text_column: str, k1: float, b: float) -> DataFrame:
    """``term, block, doc_id, impact`` of every document and term of ``terms (term)``: what one query occurrence adds to its score."""
    counted = docs.select("doc_id", X.tokens(F.col(text_column)).alias("tokens")).withColumn("length", F.size("tokens"))
    counted = stage(
        counted.select("doc_id", "length", F.explode("tokens").alias("term")).join(terms, "term", "left_semi").groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf")),
        "search-counts",
    )
    totals = docs.select(F.size(X.tokens(F.col(text_column))).alias("length")).agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("mean")).alias("t")).scalar()
    idf = F.log(F.lit(1.0) + (totals["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = counted.groupBy("term").agg(F.count("*").alias("df")).select("term", idf.alias("idf"))
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("length") / totals["mean"])
    impact = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int")
    return counted.join(weights, "term").select("term", block.alias("block"), "doc_id", impact.alias("impact"))


def bm25_join(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    k1: float = 1.2,
    b: float = 0.75,
    text_column: str = "clean_text",
    block_docs: int = BLOCK_DOCS,
    sent_rows: int = SENT_ROWS,
) -> DataFrame:
    """``query_id, rank, doc_id, bm25``: the best ``k`` documents of ``docs`` for each of ``queries (query_id, text)``, equal scores by ``doc_id``.

    Postings lie in blocks of documents, and of each term and block the greatest impact is known. Their sums bound what a query can reach
    in a block. A query scores its most promising blocks, takes its k-th best score there as the bar, and then only the blocks
    whose bound reaches it. Postings are dealt by block, and scores are summed and ranked where they lie: a document with a score
    is not shuffled unless it is among the best of its task. Above ``sent_rows`` terms of queries or chosen blocks, terms meet postings by term and block instead. Either way a term
    of all documents has as many tasks as there are blocks.
    Documents that score nothing, and queries without a known term, have no rows. ``query_id`` names one query.
    """
    words = stage(
        queries.select("query_id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")), "search-queries"
    )
    n_words, n_blocks = words.count(), max(1, -(-docs.count() // block_docs))
    index = stage(postings(docs, words.select("term").distinct(), n_blocks, text_column, k1, b), "search-index")
    tops = index.groupBy("term", "block").agg(F.max("impact").alias("top"))
    bounds = stage(words.join(tops, "term").groupBy("query_id", "block").agg(F.sum(F.col("times") * F.col("top")).alias("bound")), "search-bounds")
    promising = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    first = bounds.withColumn("place", promising).filter(F.col("place") <= FIRST_BLOCKS).drop("place")

    def scored(chosen: DataFrame) -> DataFrame:
        chosen = stage(chosen.select("query_id", "block"), "search-chosen")
        if max(n_words, chosen.count()) <= sent_rows:
            asked = index.repartition("block").join(F.broadcast(words), "term").join(F.broadcast(chosen), ["query_id", "block"], "left_semi")
        else:
            asked = words.join(chosen, "query_id").join(index, ["term", "block"])
        found = asked.groupBy("query_id", "block", "doc_id").agg(F.sum(F.col("times") * F.col("impact")).alias("bm25")).drop("block")
        return _best(found.withColumn("bm25", F.round("bm25", 6)).filter("bm25 > 0"), k)

    start = stage(scored(first), "search-first")
    bar = start.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("bm25"))).alias("bar"))
    rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(bar, "query_id", "left")
    rest = rest.filter(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - _SLACK))
    return _best(start.drop("rank").unionByName(scored(rest).drop("rank")), k).select("query_id", "rank", "doc_id", "bm25")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bm25"), "doc_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)
