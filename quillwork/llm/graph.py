"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _stars(scratch: Scratch, edges: DataFrame, large: bool) -> DataFrame:
    """Ties neighbours to the least of a node's neighbourhood: the larger ones, or the node with its smaller ones."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))  # so that the join can split a hub
    tied = both.join(least, "a")
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node and the least node of its component, from undirected edges (a, b) of long ids; nulls join nothing.

    Every round is written down; rounds grow with the logarithm of the longest chain.
    """
    state, seen = scratch.cut(edges.where("a <> b").select("a", "b").distinct()), None
    while True:
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == seen or not now.n:
            break
        seen = now
        last, state = state, scratch.cut(_stars(scratch, _stars(scratch, state, True), False))
        scratch.drop(last)
    return state.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(state.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
