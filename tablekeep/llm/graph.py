"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekeep.llm.common import settle


def _linked(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, component)`` for edges ``(a, b)`` of integers: the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes, a number of rounds that
    grows with the logarithm of the longest path. A step hangs each node's neighbours on its
    smallest one: minima are combined before the shuffle and joined back as one row per node,
    so a node with very many neighbours is split by the skew join. Each round is settled.
    Self links and nulls are ignored, repeated links count once; no edges give no rows.
    """
    edges = settle(edges.where("a <> b").select(*_linked(F.col("a"), F.col("b"))).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(*_linked(F.col("b"), F.col("m")))
        edges = settle(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
