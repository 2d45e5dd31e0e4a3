"""Connected components of a link table by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end (a) has one smaller end (b), which is no larger end itself: then each component is a star
    around its smallest node."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("larger"), F.lit(0).alias("smaller")), F.struct(F.col("b").alias("node"), F.lit(0).alias("larger"), F.lit(1).alias("smaller")))))
    return ends.groupBy("node").agg(F.sum("larger").alias("n"), F.max("smaller").alias("smaller")).where("n > 1 OR (n > 0 AND smaller > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link; edges has columns a and b.

    Each round relinks a node's larger neighbours to its smallest, then all its smaller neighbours and itself to the
    smallest of them, until every node is linked to the smallest of its component and to nothing else, however many rounds
    that takes; their number grows with the logarithm of the longest path. The smallest neighbour is an aggregate that is joined
    back, so a node with very many links is no single task's work. Each round is checkpointed; an empty table of
    links gives an empty result."""
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        pairs = _both(edges)
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pairs.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        linked = large.withColumnRenamed("a", "u").join(small, "u")
        edges = linked.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))).where("a <> b").distinct()
        edges = durable(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
