"""Line deduplication over a whole corpus (operator 13).

1. Every text is exploded into its lines. A line's key is the line without white space at its ends, A-Z lower-cased; only keys of
   some length are of interest. A key goes on as two 64-bit hashes, so that no text is moved.
2. Distinct documents are counted per hash: first per hash and document, then per hash, so the copies of one line are added up
   where they lie before they meet.
3. Lines whose hash passes the threshold, in all documents but the one of the largest id, are gathered as positions per document, and
   each text is put together again from the positions that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import lower_ascii
from storyspark.operators.hotkeys import attach_unique
from storyspark.session import stage

#: A line ends at a line feed; of the six ASCII white-space characters the other five can stand in a line.
_BLANK = "\x20\x09\x0b\x0c\x0d"
_KEY = ["h1", "h2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_hash(text: Column) -> Column:
    """Tells rows of one id apart, and spreads rows without id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_facts(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, text_hash, position, h1, h2`` of every line whose key has at least ``min_chars`` code points."""
    keys = F.transform(_lines(F.col("text")), lambda line: lower_ascii(F.btrim(line, F.lit(_BLANK))))
    # The hash of the text is made before lines are exploded: behind that, it would be made for each of them.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash(F.col("text")).alias("text_hash"), keys.alias("keys"))
    lines = rows.select("doc_id", "text_hash", F.posexplode("keys").alias("position", "key"))
    return lines.filter(F.length("key") >= min_chars).select("doc_id", "text_hash", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def repeated_lines(facts: DataFrame, min_docs: int) -> DataFrame:
    """``h1, h2, n_docs, n_lines, keeper`` of the lines that are found in at least ``min_docs`` documents; ``keeper`` is the largest id.

    Rows of one id are one document; so are all rows without id, which count as less than every id.
    """
    per_document = facts.groupBy(*_KEY, "doc_id").agg(F.count("*").alias("lines"))
    counted = per_document.groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.sum("lines").alias("n_lines"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("n_docs") >= min_docs)


def dropped_positions(facts: DataFrame, min_docs: int) -> DataFrame:
    """``doc_id, text_hash, dropped``: the positions of the lines that go, of documents that lose any."""
    found = stage(repeated_lines(facts, min_docs).withColumn("key", F.struct(*_KEY)).drop(*_KEY, "n_docs"), "line-repeats")
    lines = facts.select("doc_id", "text_hash", "position", F.struct(*_KEY).alias("key"))
    going = attach_unique(lines, found, "key", "n_lines").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return going.groupBy("doc_id", "text_hash").agg(F.collect_set("position").alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` without lines that many documents hold, with ``n_lines`` (before) and ``n_dropped`` as last columns.

    A text is split at line feeds; null and empty texts have one empty line, and come back as empty texts. Lines whose key has at least
    ``min_chars`` code points and is found in at least ``min_docs`` documents go everywhere but in the document of the largest id that holds
    it, which keeps each of them. The other lines stay as they are, joined by line feeds. Rows of one id count as one document and rows without
    id together as one, less than all others; every row gets its own result, repeated ones the same. Columns of ``docs`` stay,
    except that columns named ``n_lines`` and ``n_dropped`` give way. An empty table gives no rows.

    Of the corpus only hashes of lines are grouped. Texts move once, to meet the positions that go; a text of any length takes
    time and memory in proportion to it.
    """
    facts = stage(line_facts(docs, min_chars), "line-facts")
    gone = dropped_positions(facts, min_docs).select(F.struct("doc_id", "text_hash").alias("_row"), F.col("dropped").alias("_dropped"))
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*kept_columns, F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash(F.col("text")).alias("text_hash")).alias("_row"))
    joined = rows.join(gone, "_row", "left").withColumn("_lines", _lines(F.col("text")))
    staying = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    kept = F.when(F.col("_dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(staying, lambda k: F.get(F.col("_lines"), k)), "\n"))
    return joined.select(
        *(kept.alias(c) if c == "text" else F.col(c) for c in kept_columns),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
