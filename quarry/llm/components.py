"""Connected components of an edge table by alternating star contractions, in joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import discard, written


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u hangs from the smallest of u's neighbourhood."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # written, so that the join deals both sides anew and can split a star's rows
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours hang from the smallest of them.  Edges have a > b."""
    least = written(e.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = e.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); root is the smallest node of its component.

    Each round is written to the shared folder; rounds grow with the logarithm of the
    longest chain.  Nodes without edges don't appear.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e, "edges")
    before = _state(e)
    while before[0]:
        old, e = e, written(_small(_large(e)), "edges")
        discard(old)
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
