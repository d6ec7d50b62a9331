"""Token-set similarity of texts and ranking by query terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.functions import text as X
from storyspark.operators.hotkeys import HOT_ROWS, attach_unique
from storyspark.session import stage


def token_sets(docs: DataFrame, text_column: str = "clean_text") -> DataFrame:
    """One row per distinct token set: ``set_id`` (lowest document), ``copies`` and sorted ``tokens``.

    Equal sets are combined by a digest before anything is compared, so copies never meet each other.
    """
    sets = docs.select("doc_id", F.sort_array(F.array_distinct(X.tokens(F.col(text_column)))).alias("tokens"))
    return (
        sets.groupBy(F.sha2(F.array_join("tokens", " "), 256).alias("digest"))
        .agg(F.min("doc_id").alias("set_id"), F.count("*").alias("copies"), F.first("tokens").alias("tokens"))
        # Texts without tokens are one group: dropping it here reads the tokens once, a filter below would twice.
        .filter(F.size("tokens") > 0)
        .select("set_id", "copies", "tokens")
    )


# Words of a set signature: 16 x 64 parity bits.
_SIGNATURE_WORDS = 16
SIGNATURE = [f"s{i}" for i in range(_SIGNATURE_WORDS)]


def parity_signature() -> list[Column]:
    """Aggregates over ``token``: every token flips one bit chosen by its hash."""
    place = F.pmod(F.xxhash64("token"), F.lit(64 * _SIGNATURE_WORDS))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(token), 64) AS int))")
    word = F.floor(place / 64)
    return [F.bit_xor(F.when(word == i, bit)).alias(name) for i, name in enumerate(SIGNATURE)]


#: Sets of at most so many tokens, and the words of 64 parity bits of pairs whose larger set is one of them. Twice as many bits as tokens show how
#: far unlike sets differ.
LEVELS = ((512, 16), (2048, 64), (2**31 - 1, 192))
#: Blocks that large sets are dealt to; more of them where a block would hold over :data:`BLOCK_SETS` sets.
BLOCKS, BLOCK_SETS = 24, 20_000


def _signatures(sets: DataFrame, n_words: int) -> DataFrame:
    """``set_id, size, s0, s1, …``: ``n_words`` longs of parity bits, of which every token flips one.

    They are columns, not an array, which keeps the code that compares them short enough to be compiled.
    """
    hashed = F.xxhash64("token")
    flips = sets.select("set_id", "size", F.explode("tokens").alias("token")).select(
        "set_id",
        "size",
        F.floor(F.pmod(hashed, F.lit(64 * n_words)) / 64).cast("int").alias("word"),
        F.expr("shiftleft(1L, cast(pmod(xxhash64(token), 64) AS int))").alias("bit"),
    )
    # Every word has a row, so that the sorted list has one place for each.
    none = sets.select("set_id", "size", F.explode(F.sequence(F.lit(0), F.lit(n_words - 1))).alias("word"), F.lit(0).cast("bigint").alias("bit"))
    words = flips.unionByName(none).groupBy("set_id", "size", "word").agg(F.bit_xor("bit").alias("bits"))
    listed = words.groupBy("set_id", "size").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return listed.select("set_id", "size", *[F.get("words", F.lit(i))["bits"].alias(name) for i, name in enumerate(_signature_names(n_words))])


def _signature_names(n_words: int) -> list[str]:
    return [f"s{i}" for i in range(n_words)]


def _sum(terms: list[Column]) -> Column:
    half = len(terms) // 2
    return terms[0] if len(terms) == 1 else _sum(terms[:half]) + _sum(terms[half:])


def side(df: DataFrame, x: str, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in keys])


def similarity_possible(threshold: float, n_words: int) -> tuple[Column, Column]:
    """The overlap needed for the threshold, and whether signatures allow it: each differing bit is a differing token."""
    needed = F.lit(threshold / (1 + threshold)) * (F.col("size_a") + F.col("size_b")) - 1e-9
    different = _sum([X.hamming(F.col(f"{s}_a"), F.col(f"{s}_b")) for s in _signature_names(n_words)])
    return needed, (F.col("size_a") + F.col("size_b") - different) / 2 >= needed


def _pairs_by_rare_tokens(sets: DataFrame, threshold: float, n_words: int, hot_rows: int) -> DataFrame:
    """``set_id_a, set_id_b`` that may be similar, among sets that share one of their rarest tokens."""
    words = sets.select("set_id", "size", F.explode("tokens").alias("token"))
    frequency = words.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").withColumn("rows", F.col("df"))
    # The most common words are in nearly every text: they get their frequency by broadcast.
    ranked = (
        attach_unique(words, frequency, "token", "rows", hot_rows)
        .groupBy("set_id", "size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
        .withColumn("shared", F.size("ranked"))
    )
    # Tokens of a single set come first in the order and match nothing: they only use up prefix places.
    alone = F.col("size") - F.col("shared")
    length = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1 - alone
    firsts = ranked.filter(length > 0).select("set_id", "size", alone.alias("alone"), F.slice("ranked", F.lit(1), length).alias("firsts"))
    keys = stage(
        firsts.join(_signatures(sets, n_words), ["set_id", "size"])
        .select("*", F.posexplode("firsts").alias("i", "t"))
        .select(F.xxhash64("t.token").alias("token"), "set_id", "size", (F.col("alone") + F.col("i")).alias("place"), *_signature_names(n_words)),
        "prefixes",
    )
    needed, alike = similarity_possible(threshold, n_words)
    # The most a pair can have in common that shares the token at these places.
    upto = F.least("place_a", "place_b") + 1
    after = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) - 1
    possible = (F.least("size_a", "size_b") >= needed) & (upto + after >= needed)
    met = side(keys, "a", "token").join(side(keys, "b", "token"), "token")
    return met.filter((F.col("set_id_a") < F.col("set_id_b")) & possible & alike).select("set_id_a", "set_id_b")


def _pairs_in_blocks(sets: DataFrame, threshold: float, above: int, n_words: int) -> DataFrame:
    """``set_id_a, set_id_b`` that may be similar, the larger of more than ``above`` tokens: every pair of blocks is one key of the join."""
    signed = stage(_signatures(sets.filter(F.col("size") >= F.lit(above + 1) * threshold - 1e-9), n_words), "signatures")
    n_blocks = max(BLOCKS, -(-signed.count() // BLOCK_SETS))
    block, others = F.pmod(F.xxhash64("set_id"), F.lit(n_blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    larger = side(signed.filter(F.col("size") > above).select(block.alias("row"), others.alias("column"), "*"), "a", "row", "column")
    smaller = side(signed.select(others.alias("row"), block.alias("column"), "*"), "b", "row", "column")
    needed, alike = similarity_possible(threshold, n_words)
    in_order = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("set_id_a") < F.col("set_id_b")))
    met = larger.join(smaller, ["row", "column"]).filter(in_order & (F.col("size_b") >= needed) & alike & (F.col("set_id_a") != F.col("set_id_b")))
    return met.select(F.least("set_id_a", "set_id_b").alias("set_id_a"), F.greatest("set_id_a", "set_id_b").alias("set_id_b"))


def similar_pairs(
    docs: DataFrame, threshold: float = 0.8, text_column: str = "clean_text", hot_rows: int = HOT_ROWS, levels: tuple[tuple[int, int], ...] = LEVELS
) -> DataFrame:
    """All pairs of distinct token sets with Jaccard at or above ``threshold``, found exactly.

    Small sets: tokens are ordered from rare to common, and two similar sets must share one of their first
    ``size - ceil(threshold * size) + 1`` tokens, so only those rare tokens are joined on. Pairs are dropped in the
    join when their sizes, or the places of the shared token, rule the threshold out. Large sets share such a token with nearly
    all others of their size, so they meet block by block instead. Either way parity signatures travel with the sets and are compared inside
    the join: a pair that they rule out is never written or shuffled. Only survivors have their tokens compared. Comparisons
    grow with the square of the sets, what is shuffled with the sets and the similar pairs.
    """
    sets = stage(token_sets(docs, text_column).withColumn("size", F.size("tokens")), "token-sets")
    (small, n_words), *larger = levels
    found = _pairs_by_rare_tokens(sets.filter(F.col("size") <= small), threshold, n_words, hot_rows)
    above = small
    for upto, n_words in larger:
        found = found.unionByName(_pairs_in_blocks(sets.filter(F.col("size") <= upto), threshold, above, n_words))
        above = upto
    likely = stage(found.distinct(), "likely-pairs")
    whole = sets.select("set_id", "copies", "size", "tokens")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return (
        likely.join(side(whole, "a"), "set_id_a")
        .join(side(whole, "b"), "set_id_b")
        .withColumn("common", common)
        .withColumn("jaccard", F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")))
        .filter(F.col("jaccard") >= threshold)
        .select(
            F.col("set_id_a").alias("doc_a"), F.col("set_id_b").alias("doc_b"), "copies_a", "copies_b", "jaccard"
        )
    )


def bm25_top(
    docs: DataFrame,
    terms: list[str],
    limit: int = 20,
    k1: float = 1.2,
    b: float = 0.75,
    text_column: str = "clean_text",
) -> DataFrame:
    """Best documents for a list of query terms by BM25: two scans and one small top-n, no shuffle of text."""
    tokens = X.tokens(F.col(text_column))
    names = [f"tf_{i}" for i in range(len(terms))]
    counted = docs.select("doc_id", tokens.alias("tokens")).select(
        "doc_id",
        F.size("tokens").alias("length"),
        *[
            (F.size("tokens") - F.size(F.array_remove("tokens", term))).alias(name)
            for name, term in zip(names, terms)
        ],
    )
    stats = counted.agg(
        F.struct(
            F.count("*").alias("n"),
            F.avg("length").alias("mean_length"),
            *[F.count_if(F.col(name) > 0).alias(name) for name in names],
        ).alias("stats")
    ).scalar()

    def part(name: str) -> Column:
        df = stats[name]
        idf = F.log(F.lit(1.0) + (stats["n"] - df + 0.5) / (df + 0.5))
        norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("length") / stats["mean_length"])
        return idf * F.col(name) * (k1 + 1) / (F.col(name) + norm)

    score = part(names[0])
    for name in names[1:]:
        score = score + part(name)
    ranked = counted.select("doc_id", "length", F.round(score, 6).alias("bm25"))
    # Documents without any term score 0 and come last; they are dropped from the few rows that are left.
    return ranked.orderBy(F.col("bm25").desc(), "doc_id").limit(limit).filter("bm25 > 0")


#: Terms whose document frequencies are broadcast, at most.
COMMON_TERMS = 100_000


def tfidf_top_terms(
    docs: DataFrame, k: int = 5, text_column: str = "clean_text", hot_rows: int | None = None
) -> DataFrame:
    """The ``k`` terms of each document with the highest ``tf * ln((N + 1) / (df + 1))``.

    Texts move once, to where their words are counted, so that a document's terms lie together. Terms of at least ``hot_rows`` documents get their document
    frequency by broadcast (see :func:`attach_unique`); by default those that hold one in :data:`COMMON_TERMS` of all counts, of which there
    are at most so many. They are most of the counts, and of these a document's best leave their task.
    """
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = docs.select("doc_id", text_column).repartition(n_parts, "doc_id").select("doc_id", F.explode(X.tokens(F.col(text_column))).alias("term"))
    counts = stage(words.groupBy("doc_id", "term").agg(F.count("*").alias("tf")), "term-counts")
    hot_rows = hot_rows or min(HOT_ROWS, counts.count() // COMMON_TERMS + 1)
    total = docs.agg(F.count("*")).scalar()
    frequency = counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("rows", F.col("df"))
    weighed = attach_unique(counts, frequency, "term", "rows", hot_rows).withColumn(
        "tfidf", F.round(F.col("tf") * F.log((total + 1) / (F.col("df") + 1)), 6)
    )
    best = W.partitionBy("doc_id").orderBy(F.col("tfidf").desc(), "term")
    return (
        weighed.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("doc_id", "rank", "term", "tf", "df", "tfidf")
    )


# Parameters of the MinHash family h -> (a * h + b) mod p over 32-bit token hashes.
_MINHASH_PRIME = 4_294_967_311
_MINHASH_SIZE = 16


def _minhash_parameters() -> list[tuple[int, int]]:
    return [(2 * i * i * 104_729 + 2 * i + 1, (i * 15_485_863) % _MINHASH_PRIME) for i in range(1, _MINHASH_SIZE + 1)]


def minhash_signatures(docs: DataFrame, text_column: str = "clean_text") -> DataFrame:
    """``(doc_id, minhash array<bigint>)`` of the token set; documents without tokens have no row."""
    words = docs.select("doc_id", F.explode(X.tokens(F.col(text_column))).alias("token"))
    hashed = words.select(
        "doc_id", F.conv(F.substring(F.md5(F.col("token").cast("binary")), 25, 8), 16, 10).cast("bigint").alias("h")
    )
    minima = [F.min((F.col("h") * a + b) % _MINHASH_PRIME) for a, b in _minhash_parameters()]
    names = [f"m{i}" for i in range(_MINHASH_SIZE)]
    return (
        hashed.groupBy("doc_id")
        .agg(*[m.alias(n) for m, n in zip(minima, names)])
        .select("doc_id", F.array(*names).alias("minhash"))
    )


def minhash_similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard: the share of equal minima."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)
