"""Connected components of an edge table by alternating stars, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _least(pairs: DataFrame) -> DataFrame:
    """of and the least of itself and its partners; a table of its own, so that joins with it can split hot nodes."""
    return written(pairs.groupBy(F.col("a").alias("of")).agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_least(both), F.col("a") == F.col("of"))
    return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    joined = edges.join(_least(edges), F.col("a") == F.col("of"))
    moved = joined.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and two independent sums of hashes, 128 bits in all: rounds that change anything change it."""
    sums = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), "b", "a"))
    return tuple(edges.agg(F.count("*"), *sums).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: long) that is not its component's smallest node.

    Rounds go on until one changes nothing; their number grows with the logarithm of the longest chain.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    before, after = None, _state(edges)
    while after != before:
        large = written(_large_star(edges).distinct(), "large")
        edges = written(_small_star(large), "small")
        before, after = after, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
