"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripline.operators.joins import at_most
from tripline.session import materialize

#: Tables of so few edges (a megabyte or two) are one partition, so steps on them need no shuffle.
SMALL_EDGES = 100_000


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node that can be reached) for every node of ``edges`` (a, b long).

    Alternates large-star and small-star steps, each written once, until every node is
    tied to its root only.
    """
    current = materialize(_ordered(edges.select("a", "b")), "edges")
    small = at_most(current, SMALL_EDGES)  # steps make no more edges than there were
    before = None
    while True:
        current = _alone(current, small)
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
        current = materialize(_small_star(_large_star(current, small), small), "edges")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _alone(edges: DataFrame, small: bool) -> DataFrame:
    return edges.coalesce(1) if small else edges


def _ordered(edges: DataFrame) -> DataFrame:
    """a > b, once."""
    edges = edges.where(F.col("a") != F.col("b"))
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """Every greater neighbour of a node is tied to the node's least neighbour (or the node)."""
    both = _alone(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), small)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(tied)


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(_alone(others.unionByName(least.select("a", F.col("m").alias("b"))), small))
