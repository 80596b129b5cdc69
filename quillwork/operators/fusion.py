"""Fusing ranked legs, and what follows from scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
LOW, MEDIUM, HIGH = 0.30, 0.45, 0.60


def rrf(legs: DataFrame, top_n: int = 20, k: int = RRF_K) -> DataFrame:
    """qid, doc_id, rrf, source and rank from (qid, leg, leg_order, doc_id, rank): the sum of 1 / (k + rank).

    ``source`` is the leg that ranks the document best, the earlier leg on ties. Sums are in leg order.
    """
    scored = legs.groupBy("qid", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("leg_order", "rank"))).alias("places"),
        F.min_by("leg", F.struct("rank", "leg_order")).alias("source"),
    )
    scored = scored.select("qid", "doc_id", "source", F.aggregate("places", F.lit(0.0), lambda s, p: s + F.lit(1.0) / (F.lit(k) + p["rank"])).alias("rrf"))
    order = Window.partitionBy("qid").orderBy(F.desc("rrf"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def confidence(score: Column, low: float = LOW, medium: float = MEDIUM, high: float = HIGH) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low").otherwise("none")


def gate(found: DataFrame, threshold: float = LOW, score: str = "sim") -> DataFrame:
    """Rows at or above the threshold; a missing score counts as 0."""
    return found.where(F.coalesce(F.col(score), F.lit(0.0)) >= threshold)
