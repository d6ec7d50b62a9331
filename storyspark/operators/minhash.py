"""Groups of similar token sets by MinHash signatures in bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.functions import text as X
from storyspark.operators.graph import connected_components
from storyspark.operators.hotkeys import rows_among
from storyspark.operators.similar import SIGNATURE, parity_signature, side, similarity_possible, token_sets
from storyspark.session import stage


def bands_for(threshold: float, recall: float, size: int) -> tuple[int, int]:
    """``(bands, rows)`` of a signature of ``size`` minima: the longest bands that two sets of the threshold's similarity share with the recall asked for."""
    fitting = [r for r in range(1, size + 1) if 1 - (1 - threshold**r) ** (size // r) >= recall]
    rows = max(fitting, default=1)
    return size // rows, rows


#: Of so many kinds that lie in a bucket, one set each is compared with all others of the bucket before all that is left is.
KINDS = 32
#: Sets of a bucket that meet under one key of the join; a larger bucket is dealt to blocks.
BUCKET_SETS = 2_000


def signatures(sets: DataFrame, size: int) -> DataFrame:
    """``set_id, size, parity, minima`` of sets ``(set_id, tokens)``: for each of ``size`` hash functions the least hash of a token, and parity bits (see ``similar``).

    Combined where a set is exploded, so one row per set travels.
    """
    words = sets.select("set_id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    names = [f"m{seed}" for seed in range(1, size + 1)]
    minima = [F.min(F.xxhash64(F.lit(seed), "token")).alias(name) for seed, name in enumerate(names, 1)]
    combined = words.groupBy("set_id", "size").agg(*minima, *parity_signature())
    parity = F.array(*(F.coalesce(word, F.lit(0).cast("bigint")) for word in SIGNATURE))
    return combined.select("set_id", "size", parity.alias("parity"), F.array(*names).alias("minima"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``u, v``, ``u`` the greater, of the ``pairs (set_id_a, set_id_b)`` whose tokens reach the threshold."""
    some = rows_among(sets.select("set_id", "tokens"), "set_id", pairs.select(F.explode(F.array("set_id_a", "set_id_b")).alias("set_id")))
    whole = pairs.join(side(some, "b"), "set_id_b").join(side(some, "a"), "set_id_a")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return whole.filter(common / (F.size("tokens_a") + F.size("tokens_b") - common) >= threshold).select(F.col("set_id_b").alias("u"), F.col("set_id_a").alias("v"))


def _kinds_met(mixed: DataFrame) -> DataFrame:
    """Pairs of a bucket's sets and one set each of its first :data:`KINDS` kinds, others than the set's own."""
    least = mixed.groupBy("bucket", "root").agg(F.min("set_id").alias("set_id"))
    first = least.withColumn("place", F.row_number().over(W.partitionBy("bucket").orderBy("set_id"))).filter(F.col("place") <= KINDS)
    return side(mixed.join(first.select("bucket", "set_id"), ["bucket", "set_id"]), "a", "bucket").join(side(mixed, "b", "bucket"), "bucket")


def _all_met(mixed: DataFrame) -> DataFrame:
    """Every two sets of a bucket, either way round: a large bucket block by block."""
    blocks = F.ceil(F.col("sets") / BUCKET_SETS).cast("int")
    own, every = F.pmod(F.xxhash64("set_id"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    keys = ["bucket", "row", "column"]
    return side(mixed.select("*", own.alias("row"), every.alias("column")), "a", *keys).join(side(mixed.select("*", own.alias("column"), every.alias("row")), "b", *keys), keys)


def minhash_links(sets: DataFrame, threshold: float, recall: float, size: int) -> DataFrame:
    """``u, v``: verified links between sets ``(set_id, tokens)`` that share a bucket. They connect whatever all similar pairs within buckets connect.

    First each set is compared with the least set of its buckets that it shares most of them with. Sets that are connected by then are of one kind and
    need no further link. In buckets that hold several kinds, sets meet a member of each of the first :data:`KINDS`, then all sets of other
    kinds that are left, so no pair that meets the threshold goes unseen unless its sets are connected. A family costs as many comparisons as it has members; kinds
    that share a bucket without being similar are compared pair by pair, by sizes and parity bits inside the join. Only of pairs that these
    allow are tokens fetched, and each pair is fetched once.
    """
    bands, rows = bands_for(threshold, recall, size)
    buckets = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("minima", i * rows + 1, rows)))
    parity = [F.get("parity", F.lit(i)).alias(name) for i, name in enumerate(SIGNATURE)]
    signed = stage(signatures(sets, size).select("set_id", "size", *parity, buckets.alias("buckets")), "minhash-signatures")
    marks = signed.drop("buckets")
    placed = signed.select("set_id", F.explode("buckets").alias("bucket"))
    crowded = placed.groupBy("bucket").agg(F.min("set_id").alias("hub"), F.count("*").alias("sets")).filter("sets > 1")
    members = stage(placed.join(crowded, "bucket"), "minhash-bands")
    needed, alike = similarity_possible(threshold, len(SIGNATURE))
    possible = (F.least("size_a", "size_b") >= needed) & alike
    shared = members.filter(F.col("set_id") > F.col("hub")).groupBy("set_id", "hub").agg(F.count("*").alias("times"))
    best = shared.groupBy(F.col("set_id").alias("set_id_b")).agg(F.min(F.struct(-F.col("times"), "hub"))["hub"].alias("set_id_a"))
    met = best.join(side(marks, "b"), "set_id_b").join(side(marks, "a"), "set_id_a").filter(possible)
    tried = stage(met.select("set_id_a", "set_id_b"), "minhash-pairs")
    links = stage(_verified(tried, sets, threshold), "minhash-links")
    for meet in (_kinds_met, _all_met):
        kinds = connected_components(links)
        rooted = members.join(kinds, F.col("set_id") == F.col("id"), "left").select("bucket", "sets", "set_id", F.coalesce("root", "set_id").alias("root"))
        several = rooted.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("bucket")
        mixed = stage(rooted.join(several, "bucket").join(marks, "set_id"), "minhash-mixed")
        if mixed.isEmpty():
            break
        met = meet(mixed).filter((F.col("root_a") != F.col("root_b")) & possible)
        if meet is _all_met:
            met = met.filter(F.col("set_id_a") < F.col("set_id_b"))
        pairs = met.select(F.least("set_id_a", "set_id_b").alias("set_id_a"), F.greatest("set_id_a", "set_id_b").alias("set_id_b")).distinct()
        new = stage(pairs.join(tried, ["set_id_a", "set_id_b"], "left_anti"), "minhash-pairs")
        links = links.unionByName(stage(_verified(new, sets, threshold), "minhash-links"))
        tried = tried.unionByName(new)
    return links.distinct()


def minhash_groups(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, size: int = 64, text_column: str = "clean_text") -> DataFrame:
    """``doc_id, group_id``: documents linked by token sets whose Jaccard similarity reaches the threshold, named by the least document.

    Copies of one set are one node. ``recall`` is that of a pair at the threshold to share a band, before anything is compared; links
    themselves are exact. Documents without tokens stand alone.
    """
    sets = stage(token_sets(docs, text_column), "minhash-sets")
    linked = connected_components(minhash_links(sets, threshold, recall, size))
    digest = F.sha2(F.array_join(F.sort_array(F.array_distinct(X.tokens(F.col(text_column)))), " "), 256)
    members = sets.select(F.sha2(F.array_join("tokens", " "), 256).alias("digest"), "set_id")
    placed = docs.select("doc_id", digest.alias("digest")).join(members, "digest", "left")
    rooted = placed.join(linked, F.col("set_id") == F.col("id"), "left")
    return rooted.select("doc_id", F.coalesce("root", "set_id", "doc_id").alias("group_id"))
