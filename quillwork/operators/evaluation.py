"""Scores of predicted answers against gold ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_tokens, citations, exact_match_form, normalize_identifier


def token_f1(pairs: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """``pairs`` (with a column qid) and ``f1``, the harmonic mean of token precision and recall over multisets.

    Two empty answers score 1, one empty answer 0. Multiset overlap is a join of token counts per pair.
    """
    keyed = pairs.withColumn("_pair", F.xxhash64("qid", predicted, gold))
    pair = keyed.select("_pair", F.col(predicted).alias("p"), F.col(gold).alias("g")).dropDuplicates(["_pair"])
    tokens = pair.select("_pair", answer_tokens(F.col("p")).alias("pt"), answer_tokens(F.col("g")).alias("gt"))
    side = lambda c: tokens.select("_pair", F.explode(c).alias("token"))
    counts = side("pt").withColumn("p", F.lit(1)).withColumn("g", F.lit(0)).unionAll(side("gt").withColumn("p", F.lit(0)).withColumn("g", F.lit(1)))
    shared = counts.groupBy("_pair", "token").agg(F.sum("p").alias("p"), F.sum("g").alias("g")).groupBy("_pair").agg(F.sum(F.least("p", "g")).alias("common"))
    sized = tokens.select("_pair", F.size("pt").alias("np"), F.size("gt").alias("ng")).join(shared, "_pair", "left")
    precision, recall = F.col("common") / F.col("np"), F.col("common") / F.col("ng")
    f1 = F.when((F.col("np") == 0) & (F.col("ng") == 0), 1.0).when((F.col("np") == 0) | (F.col("ng") == 0) | (F.coalesce("common", F.lit(0)) == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))
    return keyed.join(sized.select("_pair", f1.alias("f1")), "_pair").drop("_pair")


def exact_match(pairs: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    return pairs.withColumn("em", exact_match_form(F.col(predicted)) == exact_match_form(F.col(gold)))


def citation_recall(rows: DataFrame, answer: str = "predicted", gold: str = "gold_citations") -> DataFrame:
    """``rows`` with the identifiers cited in the answer and their recall; null without gold ones."""
    wanted = F.array_distinct(F.transform(F.coalesce(gold, F.array().cast("array<string>")), normalize_identifier))
    cited = F.array_distinct(citations(F.col(answer)))
    return rows.withColumn("cited", cited).withColumn("citation_recall", F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, cited)) / F.size(wanted)))


def evaluate(samples: DataFrame) -> DataFrame:
    """One row per question from (qid, predicted, golds, gold_citations): em, the best f1 and citation recall."""
    pairs = samples.select("qid", "predicted", F.explode_outer("golds").alias("gold"))
    scored = exact_match(token_f1(pairs)).groupBy("qid").agg(F.max("f1").alias("f1"), F.bool_or("em").alias("em"))
    return citation_recall(samples).select("qid", "predicted", F.size("golds").alias("gold_count"), "cited", "citation_recall").join(scored, "qid")


def summary(evaluated: DataFrame) -> DataFrame:
    matched = F.count_if("em")
    return evaluated.agg(
        F.count("*").alias("total"),
        matched.alias("exact_match"),
        F.coalesce(F.try_divide(matched, F.count("*")), F.lit(0.0)).alias("exact_match_rate"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("avg_f1"),
        F.coalesce(F.avg("citation_recall"), F.lit(0.0)).alias("citation_recall_avg"),
    )
