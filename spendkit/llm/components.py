"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import cut_lineage


def _large(edges: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the least node that it sees."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    own = least.select("a", F.col("root").alias("b"))
    others = down.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return own.unionByName(others)


def components(links: DataFrame, parts: int) -> DataFrame:
    """(node, root) of every node of `links` (a, b); root is the least node that links reach.

    Each round is two aggregates and two joins over at most as many edges as before; rounds grow with the
    logarithm of the longest path. Nothing of the links comes to the driver but a count and a checksum. `parts`
    bounds the tasks of a stage: links are few numbers each, and a task per shuffle partition would do nothing.
    """
    edges, seen = cut_lineage(links.select("a", "b").where("a <> b").coalesce(parts)), None
    while True:
        edges = cut_lineage(_small(_large(edges).coalesce(parts)).distinct().coalesce(parts))
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
