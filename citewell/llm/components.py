"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _written(edges: DataFrame) -> DataFrame:
    return scratch.write(edges.sparkSession, edges.filter(F.col("a") != F.col("b")).distinct(), "edges")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of its neighbourhood."""
    both = _pairs(edges)
    least = scratch.write(edges.sparkSession, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    moved = _written(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("b"), F.col("m").alias("a")))
    scratch.drop(edges.sparkSession, least)
    return moved


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = scratch.write(edges.sparkSession, down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    both = _written(moved.unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a"))))
    scratch.drop(edges.sparkSession, least)
    return both


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b); nodes without edges don't appear.

    Each step of a round is written to the shared folder by itself, so that no plan holds a step twice: the driver's
    memory goes with the plans.  Rounds grow with the logarithm of the nodes.
    """
    spark = edges.sparkSession
    current = _written(edges.select("a", "b"))
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        half = _large(current)
        scratch.drop(spark, current)
        current = _small(half)
        scratch.drop(spark, half)
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
