"""Statistics kept up to date: counts by day and category, author or pair, changed by what a batch changes.

A batch takes the old contributions of its papers out and puts the new ones in; statistics roll the counts up and read no
table of papers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import between_days, period
from ..sources.tables import Draft
from .stats import _limit

#: Name, columns and key of each cube; ``papers`` counts.
CUBES = {
    "cube_days": ("day date, papers long", ["day"]),
    "cube_categories": ("day date, category_code string, papers long", ["day", "category_code"]),
    "cube_authors": ("day date, author_id long, papers long", ["day", "author_id"]),
    "cube_pairs": ("a string, b string, papers long", ["a", "b"]),
}


def create(draft: Draft, bucket_rows: int = 100_000) -> None:
    for name, (schema, keys) in CUBES.items():
        draft.create(name, schema, keys, bucket_rows)


def contributions(papers: DataFrame, paper_categories: DataFrame, paper_authors: DataFrame, date: str = "published_date") -> dict[str, DataFrame]:
    """What some papers with all their links add to each cube."""
    dated = papers.select(F.col("arxiv_id").alias("paper_id"), F.to_date(date).alias("day"))
    codes = paper_categories.select("paper_id", "category_code").distinct().join(dated, "paper_id")
    count = F.count("*").alias("papers")
    pairs = codes.select("paper_id", F.col("category_code").alias("a")).join(codes.select("paper_id", F.col("category_code").alias("b")), "paper_id").where("a < b")
    return {
        "cube_days": dated.groupBy("day").agg(count),
        "cube_categories": codes.groupBy("day", "category_code").agg(count),
        "cube_authors": paper_authors.select("paper_id", "author_id").distinct().join(dated, "paper_id").groupBy("day", "author_id").agg(count),
        "cube_pairs": pairs.groupBy("a", "b").agg(count),
    }


def change(draft: Draft, old: dict[str, DataFrame], new: dict[str, DataFrame]) -> None:
    """Changes the cubes of a draft by what the papers of a batch contributed before and do now."""
    for name, (_, keys) in CUBES.items():
        moved = new[name].unionByName(old[name].withColumn("papers", -F.col("papers")))
        delta = moved.groupBy(*keys).agg(F.sum("papers").alias("papers")).where("papers <> 0")
        draft.merge(name, delta, _summed(keys))


def _summed(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda held, batch: held.unionByName(batch.select(*held.columns)).groupBy(*keys).agg(F.sum("papers").alias("papers")).where("papers <> 0").select(*held.columns)


def _ranged(cube: DataFrame, first: str | None, last: str | None) -> DataFrame:
    return between_days(cube.withColumn("day", F.col("day").cast("timestamp")), "day", first, last)


def _total(cube: DataFrame, *keys: str) -> DataFrame:
    return cube.groupBy(*keys).agg(F.sum("papers").alias("paper_count"))


def top_categories(cubes: dict[str, DataFrame], categories: DataFrame, limit: int = 10, first: str | None = None, last: str | None = None) -> DataFrame:
    counted = _total(_ranged(cubes["cube_categories"], first, last), "category_code")
    named = counted.join(categories, counted["category_code"] == categories["code"])
    return named.select("code", "display_name", "paper_count").orderBy(F.desc("paper_count"), "code").limit(_limit(limit, 100))


def category_total(cubes: dict[str, DataFrame], categories: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    codes = _ranged(cubes["cube_categories"], first, last).select(F.col("category_code").alias("code"))
    return codes.join(categories, "code", "left_semi").agg(F.count_distinct("code").alias("total"))


def categories_over_time(cubes: dict[str, DataFrame], granularity: str = "month", category: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    rows = _ranged(cubes["cube_categories"], first, last)
    rows = rows if category is None else rows.where(F.col("category_code") == category)
    return _total(rows.withColumn("period", period(F.col("day"), granularity)), "period", "category_code").orderBy("period", "category_code")


def top_authors(cubes: dict[str, DataFrame], authors: DataFrame, limit: int = 20, first: str | None = None, last: str | None = None) -> DataFrame:
    counted = _total(_ranged(cubes["cube_authors"], first, last), "author_id")
    named = counted.join(authors, counted["author_id"] == authors["id"])
    return named.select("author_id", F.col("name").alias("author"), "paper_count").orderBy(F.desc("paper_count"), "author_id").limit(_limit(limit, 100))


def velocity(cubes: dict[str, DataFrame], granularity: str = "week", first: str | None = None, last: str | None = None) -> DataFrame:
    rows = _ranged(cubes["cube_days"], first, last).withColumn("period", period(F.col("day"), granularity))
    return _total(rows, "period").orderBy("period")


def cooccurrence(cubes: dict[str, DataFrame], limit: int | None = 20) -> DataFrame:
    pairs = cubes["cube_pairs"].select("a", "b", F.col("papers").alias("together"))
    return pairs if limit is None else pairs.orderBy(F.desc("together"), "a", "b").limit(_limit(limit, 200))
