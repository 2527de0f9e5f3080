"""Connected components in a number of rounds that grows with the logarithm of paths: large and small stars.

A large star ties each node's greater neighbours to the least of its
neighbourhood, a small star its lesser ones and itself; by turns they halve
distances until every component is one star around its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.operators.lineage import cut
from sluicegate.operators.skew import with_fact


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))  # a: the node, b: a neighbour
    least = with_fact(both, "a", F.least(F.min("b"), F.first("a")), "least", 2 * n)
    return least.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = with_fact(edges, "a", F.min("b"), "least", n)
    return least.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(edges.groupBy("a").agg(F.min("b").alias("b")))


def stars(edges: DataFrame) -> tuple[DataFrame, int]:
    """(each node but the least of its component with that least one: ``a``, ``b``; the rounds it took).

    edges: ``a`` > ``b``.  A round is one large and one small star; the last
    round finds nothing to change.
    """
    edges = cut(edges.distinct())
    mark = _mark(edges)
    for rounds in range(1, 1 << 10):
        if not mark[0]:
            return edges, rounds
        bigger = _large_star(edges, mark[0]).distinct()
        edges = cut(_small_star(cut(bigger), mark[0]).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            return edges, rounds
    raise RuntimeError("components do not settle")


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal before and after a round only if nothing changed."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def of_shared(ways: DataFrame, item: str, word: str) -> DataFrame:
    """``item`` and ``component`` (the least item reachable over shared words) of each item.

    ways: (item, word), word null for an item without one.  Each word ties its
    items to the least of them, so a word's items cost one edge each.
    """
    once = cut(ways.select(F.col(item).alias("item"), F.col(word).alias("word")).distinct())
    tied = with_fact(once, "word", F.min("item"), "least", once.count())
    found, _ = stars(tied.where("least < item").select(F.col("item").alias("a"), F.col("least").alias("b")))
    return once.select("item").distinct().join(found, F.col("item") == F.col("a"), "left").select(F.col("item").alias(item), F.coalesce("b", "item").alias("component"))
