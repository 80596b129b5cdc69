"""The statistics of the star model. Ties go by key, so results are stable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import between_days, period


def _limit(n: int, most: int) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"limit must be from 1 to {most}, not {n}")
    return n


def summary(papers: DataFrame, authors: DataFrame, categories: DataFrame, paper_categories: DataFrame, date: str = "published_date") -> DataFrame:
    """One row: counts, the date range (null without papers) and the five largest categories."""
    top = top_categories(papers, categories, paper_categories, limit=5, date=date)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("paper_count")).alias("order"), "code", "paper_count"))).alias("x")).select(F.transform("x", lambda c: F.struct(c["code"].alias("code"), c["paper_count"].alias("paper_count"))).alias("top_categories"))
    range_ = F.struct(F.to_date(F.min(date)).cast("string").alias("from"), F.to_date(F.max(date)).cast("string").alias("to"))
    one = papers.agg(F.count("*").alias("total_papers"), F.when(F.count(date) > 0, range_).alias("date_range"))
    return one.crossJoin(authors.agg(F.count("*").alias("total_authors"))).crossJoin(categories.agg(F.count("*").alias("total_categories"))).crossJoin(listed)


def top_categories(papers: DataFrame, categories: DataFrame, paper_categories: DataFrame, limit: int = 10, first: str | None = None, last: str | None = None, date: str = "published_date") -> DataFrame:
    joined = _categorised(papers, categories, paper_categories, first, last, date)
    return joined.groupBy("code", "display_name").agg(F.count("*").alias("paper_count")).orderBy(F.desc("paper_count"), "code").limit(_limit(limit, 100))


def category_total(papers: DataFrame, categories: DataFrame, paper_categories: DataFrame, first: str | None = None, last: str | None = None, date: str = "published_date") -> DataFrame:
    return _categorised(papers, categories, paper_categories, first, last, date).agg(F.count_distinct("code").alias("total"))


def _categorised(papers, categories, paper_categories, first, last, date):
    kept = between_days(papers, date, first, last)
    links = paper_categories.join(categories, paper_categories["category_code"] == categories["code"]).select("paper_id", "code", "display_name")
    return links.join(kept.select(F.col("arxiv_id").alias("paper_id")), "paper_id")


def categories_over_time(papers: DataFrame, paper_categories: DataFrame, granularity: str = "month", category: str | None = None, first: str | None = None, last: str | None = None, date: str = "published_date") -> DataFrame:
    links = paper_categories if category is None else paper_categories.where(F.col("category_code") == category)
    dated = between_days(papers, date, first, last).select(F.col("arxiv_id").alias("paper_id"), period(F.col(date), granularity).alias("period"))
    return dated.join(links, "paper_id").groupBy("period", "category_code").agg(F.count("*").alias("paper_count")).orderBy("period", "category_code")


def top_authors(papers: DataFrame, authors: DataFrame, paper_authors: DataFrame, limit: int = 20, first: str | None = None, last: str | None = None, date: str = "published_date") -> DataFrame:
    """Counts by author id, so namesakes stay apart."""
    kept = between_days(papers, date, first, last).select(F.col("arxiv_id").alias("paper_id"))
    counted = paper_authors.join(kept, "paper_id").groupBy("author_id").agg(F.count("*").alias("paper_count"))
    named = counted.join(authors, counted["author_id"] == authors["id"])
    return named.select("author_id", F.col("name").alias("author"), "paper_count").orderBy(F.desc("paper_count"), "author_id").limit(_limit(limit, 100))


def velocity(papers: DataFrame, granularity: str = "week", first: str | None = None, last: str | None = None, date: str = "published_date") -> DataFrame:
    dated = between_days(papers, date, first, last).select(period(F.col(date), granularity).alias("period"))
    return dated.groupBy("period").agg(F.count("*").alias("paper_count")).orderBy("period")


def cooccurrence(links: DataFrame, limit: int | None = 20, key: str = "paper_id", value: str = "category_code") -> DataFrame:
    """Pairs a < b of values on the same key, by how many keys have both."""
    one = links.select(key, F.col(value).alias("a")).distinct()
    two = one.select(key, F.col("a").alias("b"))
    pairs = one.join(two, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("together"))
    return pairs if limit is None else pairs.orderBy(F.desc("together"), "a", "b").limit(_limit(limit, 200))


def readiness(papers: DataFrame, embedding: str = "embedding") -> DataFrame:
    return papers.agg(F.count("*").alias("total"), F.count(embedding).alias("embedded"))
