"""Connected components of a table of links, by repeated contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from impactrec.staging import stage


def _pointers(links: DataFrame) -> DataFrame:
    """For every node the least of itself and its neighbours."""
    least, most = F.least("a", "b").alias("p"), F.greatest("a", "b").alias("node")
    # A link points the larger end at the smaller; the smaller end points at itself unless another link says less.
    up = links.select(most, least)
    roots = links.select(F.least("a", "b").alias("node"), F.least("a", "b").alias("p"))
    return up.unionByName(roots).groupBy("node").agg(F.min("p").alias("p"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: equal roots, same component.

    Each round lets every node point at its least neighbour and replaces the links by links between
    the targets, until none is left. Nodes should be hashes, so that their order is random and a
    round removes a constant part of them; a star goes in two rounds. Every round is written, and
    minima are combined before the shuffle, so that a node with many links is no hot key.
    """
    rounds = []
    left = stage(links.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    while not left.isEmpty():
        pointers = stage(_pointers(left))
        rounds.append(pointers)
        to_a = pointers.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        to_b = pointers.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        moved = left.join(to_a, "a").join(to_b, "b").where(F.col("pa") != F.col("pb"))
        left = stage(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].select("node", F.col("p").alias("root"))
    for pointers in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("p"), "root")
        roots = pointers.join(later, "p", "left").select("node", F.coalesce("root", "p").alias("root"))
    return stage(roots)
