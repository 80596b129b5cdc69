"""Schemas of the star model, and checks that stand in for a database's constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAPERS = "arxiv_id string, title string, abstract string, abstract_clean string, published_date timestamp, updated_date timestamp, doi string, journal_ref string, primary_category_code string, created_at timestamp, updated_at timestamp"
AUTHORS = "id long, name string, name_normalized string"
PAPER_AUTHORS = "paper_id string, author_id long, position short"
CATEGORIES = "code string, display_name string"
PAPER_CATEGORIES = "paper_id string, category_code string, is_primary boolean"
CONCEPTS = "id long, name string, concept_type string"
PAPER_CONCEPTS = "paper_id string, concept_id long"
RUNS = "id long, started_at timestamp, completed_at timestamp, status string, date_from timestamp, date_to timestamp, categories array<string>, papers_fetched int, papers_inserted int, papers_updated int, papers_embedded int, last_checkpoint struct<done:array<string>,current:struct<category:string,date_window:string,offset:int>>, error_message string"
RAW_PAPERS = "arxiv_id string, title string, abstract string, published string, updated string, authors array<string>, primary_category string, categories array<string>, doi string, journal_ref string"


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose non-null key is missing in ``parent``."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti").select(*child.columns)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, and how many have them."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """``child`` without the rows whose parent is gone."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_semi").select(*child.columns)


def check_dimension(df: DataFrame, column: str, dim: int) -> None:
    """An error if a vector has another length than ``dim``."""
    found = df.agg(F.min(F.size(column)).alias("low"), F.max(F.size(column)).alias("high")).where("low is not null").first()
    if found and (found.low, found.high) != (dim, dim):
        raise ValueError(f"{column} has vectors of {found.low} to {found.high} numbers, expected {dim}")
