"""Roots of parent chains and connected components, in a logarithmic number of rounds.

Every round is written to the shared stage folder, so the plan stays short and a lost executor
never replays earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyspark.operators.hotkeys import HOT_ROWS, attach_unique
from storyspark.session import stage


def resolve_roots(parents: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, parent)`` forest to ``(id, root)``; a root is its own parent.

    A parent without a row of its own counts as a root, so roots may be left out. Only nodes that are somebody's
    parent take part in the pointer doubling; all other nodes read their parent's root once at the end.
    """
    children = parents.filter("id <> parent")
    wanted = children.groupBy("parent").agg(F.count("*").alias("n"))
    inner = stage(
        wanted.join(children.select(F.col("id").alias("parent"), F.col("parent").alias("ptr")), "parent").select(
            F.col("parent").alias("id"), "ptr"
        ),
        "chain",
    )
    moving = not inner.isEmpty()
    while moving:
        targets = inner.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"))
        steps = (
            inner.groupBy("ptr")
            .agg(F.count("*").alias("n"))
            .join(targets, "ptr", "left")
            .select("ptr", "n", F.coalesce("next", "ptr").alias("next"), F.col("next").isNotNull().alias("moved"))
        )
        jumped = stage(attach_unique(inner, steps, "ptr", "n", hot_rows), "chain")
        moving = not jumped.filter("moved").isEmpty()
        inner = jumped.select("id", F.col("next").alias("ptr"))
    roots = wanted.join(inner.select(F.col("id").alias("parent"), "ptr"), "parent", "left").select(
        "parent", "n", F.coalesce("ptr", "parent").alias("root")
    )
    return (
        attach_unique(children, roots, "parent", "n", hot_rows)
        .select("id", "root")
        .unionByName(parents.filter("id = parent").select("id", F.col("id").alias("root")))
    )


def connected_components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(u, v)`` edges to ``(id, root)`` with the smallest member as root.

    Alternating large-star and small-star contraction (Kiveris et al., 2014), written with minima and
    joins so that no neighbour list is ever collected.
    """
    pairs = stage(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "components",
    )
    seen = None
    while True:
        summary = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if summary == seen:
            break
        seen = summary
        large = stage(_large_star(pairs, hot_rows), "components")
        pairs = stage(_small_star(large, hot_rows), "components")
    leaves = pairs.select(F.col("u").alias("id"), F.col("v").alias("root"))
    centres = pairs.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return leaves.unionByName(centres)


def _large_star(pairs: DataFrame, hot_rows: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(
        F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")
    )
    linked = attach_unique(both.filter("v > u"), smallest, "u", "n", hot_rows)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame, hot_rows: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = attach_unique(pairs, smallest, "u", "n", hot_rows)
    return (
        linked.select("u", F.col("m").alias("v"))
        .unionByName(linked.select(F.col("v").alias("u"), F.col("m").alias("v")))
        .filter("u <> v")
        .distinct()
    )
