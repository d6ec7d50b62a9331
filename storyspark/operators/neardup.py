"""SimHash fingerprints and exact near-duplicate pairs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.functions import text as X
from storyspark.operators.graph import connected_components
from storyspark.operators.hotkeys import attach_unique
from storyspark.session import stage

_BITS = X.HASH_BITS
# Bucket size above which a bucket is cut further. Smaller buckets compare all their hashes.
MAX_BUCKET = 2_000
_REFINEMENTS = 3


def document_simhash(docs: DataFrame, text_column: str = "clean_text") -> DataFrame:
    """``(doc_id, simhash, token_count)``; texts without tokens get 0.

    Counters are packed and combined before the shuffle: one row of 32 sums per document travels.
    """
    words = docs.select("doc_id", F.explode_outer(X.tokens(F.col(text_column))).alias("token"))
    counted = words.select("doc_id", X.token_hash(F.col("token")).alias("h")).groupBy("doc_id").agg(
        F.count("h").alias("token_count"), *X.simhash_counters(F.col("h"))
    )
    empty = F.col("token_count") == 0
    return counted.select(
        "doc_id",
        F.when(empty, F.lit(0).cast("bigint"))
        .otherwise(X.simhash_from_counters(F.col("token_count")))
        .alias("simhash"),
        "token_count",
    )


def duplicate_groups(hashes: DataFrame) -> DataFrame:
    """``(simhash, doc_id, copies)``: the lowest document of every fingerprint; texts without tokens are left out."""
    return (
        hashes.filter("token_count > 0")
        .groupBy("simhash")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    )


def duplicate_members(hashes: DataFrame) -> DataFrame:
    """``(doc_id, group_id)`` of every document with tokens: the lowest document with the same fingerprint names the group."""
    groups = duplicate_groups(hashes).withColumnRenamed("doc_id", "group_id")
    return attach_unique(hashes.filter("token_count > 0").select("doc_id", "simhash"), groups, "simhash", "copies").select("doc_id", "group_id")


def near_duplicate_groups(hashes: DataFrame, max_distance: int = 3) -> DataFrame:
    """``(doc_id, group_id)`` of every document with tokens: groups connected by fingerprints at most ``max_distance`` bits apart.

    The lowest document names the group. One row per document, however large the groups are.
    """
    members = stage(duplicate_members(hashes), "duplicate-members")
    pairs = near_duplicate_pairs(hashes, max_distance).select(F.col("doc_a").alias("u"), F.col("doc_b").alias("v"))
    roots = connected_components(pairs).select(F.col("id").alias("group_id"), "root")
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n"))
    named = sizes.join(roots, "group_id", "left").select("group_id", "n", F.coalesce("root", "group_id").alias("root"))
    return attach_unique(members, named, "group_id", "n").select("doc_id", F.col("root").alias("group_id"))


def near_duplicate_pairs(hashes: DataFrame, max_distance: int = 3, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Pairs of different fingerprints at most ``max_distance`` bits apart.

    ``(doc_a, doc_b, copies_a, copies_b, similarity)``, with the lowest document of each fingerprint standing
    for all its copies (see :func:`duplicate_groups`). Nothing is missed: the 64 bits are cut into
    ``2 * max_distance`` blocks, and two such hashes agree on at least half of the blocks, so every choice of
    that many blocks is a bucket key of about 32 bits. A bucket with too many hashes is cut again: its free
    bits fall into ``max_distance + 1`` lanes, of which one must agree as well.
    """
    groups = stage(duplicate_groups(hashes), "simhash-groups")
    keyed = groups.select("simhash", F.explode(_longs(_block_masks(max_distance))).alias("mask"))
    found = []
    for level in range(_REFINEMENTS + 1):
        rows = stage(keyed.withColumn("key", F.col("simhash").bitwiseAND(F.col("mask"))), "simhash-buckets")
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        last = level == _REFINEMENTS
        small = sizes if last else sizes.filter(F.col("n") <= max_bucket)
        found.append(_pairs_in_buckets(rows, small.drop("n"), max_distance))
        if last:
            break
        crowded = sizes.filter(F.col("n") > max_bucket).drop("n")
        if crowded.isEmpty():
            break
        # Fewer than rows / max_bucket buckets are crowded.
        keyed = rows.join(crowded, ["mask", "key"], "left_semi").select(
            "simhash", F.explode(_refined_masks(F.col("mask"), max_distance + 1, level)).alias("mask")
        )
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    a = groups.select(F.col("simhash").alias("a"), F.col("doc_id").alias("id_1"), F.col("copies").alias("copies_1"))
    b = groups.select(F.col("simhash").alias("b"), F.col("doc_id").alias("id_2"), F.col("copies").alias("copies_2"))
    swap = F.col("id_1") > F.col("id_2")
    return (
        pairs.distinct()
        .join(a, "a")
        .join(b, "b")
        .select(
            F.least("id_1", "id_2").alias("doc_a"),
            F.greatest("id_1", "id_2").alias("doc_b"),
            F.when(swap, F.col("copies_2")).otherwise(F.col("copies_1")).alias("copies_a"),
            F.when(swap, F.col("copies_1")).otherwise(F.col("copies_2")).alias("copies_b"),
            X.simhash_similarity(F.col("a"), F.col("b")).alias("similarity"),
        )
    )


def _pairs_in_buckets(rows: DataFrame, buckets: DataFrame, max_distance: int) -> DataFrame:
    """Verified pairs inside the given buckets; a failing pair never leaves the join."""
    members = rows.join(buckets, ["mask", "key"], "left_semi")
    left = members.select("mask", "key", F.col("simhash").alias("a"))
    right = members.select("mask", "key", F.col("simhash").alias("b"))
    close = (F.col("a") < F.col("b")) & (X.hamming(F.col("a"), F.col("b")) <= max_distance)
    return left.join(right, ["mask", "key"]).filter(close).select("a", "b")


def _signed(value: int) -> int:
    return value - (1 << _BITS) if value >= 1 << (_BITS - 1) else value


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("bigint") for v in values])


def _block_masks(max_distance: int) -> list[int]:
    """Masks of every choice of half of the blocks."""
    blocks = 2 * max_distance
    edges = [round(i * _BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(masks, max_distance)]


def _refined_masks(mask: Column, lanes: int, level: int) -> Column:
    """The mask widened by each lane of its free bits; lanes are interleaved, wider at each level."""
    width = lanes**level
    lane_bits = [
        sum(1 << bit for bit in range(_BITS) if (bit // width) % lanes == lane) for lane in range(lanes)
    ]
    return F.array(*[mask.bitwiseOR(F.lit(_signed(bits)).cast("bigint")) for bits in lane_bits])
