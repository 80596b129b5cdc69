"""Indexing what is pending: vectors and concepts through callables, and the log of runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens, casefold, document_text
from ..operators import concepts, upsert

Embed = Callable[[list[str]], list[list[float]]]


#: After so many failed batches in a row a task gives up.
FAILURES = 3


def embed_pending(papers: DataFrame, embed: Embed, model: str, dim: int, *, key: str = "arxiv_id", title: str = "title", abstract: str = "abstract_clean", batch: int = 100, attempts: int = 3, wait: float = 3.5, skipped: tuple[type[Exception], ...] = (OSError,)) -> DataFrame:
    """key, embedding and embedding_model for the rows of ``papers`` that need a vector and have a text.

    The callable gets ``batch`` texts at a time, in order, on the workers; a vector of another length is an error.
    A call that fails with one of ``skipped`` is tried ``attempts`` times, after ``wait`` seconds and then twice as long each
    time; a batch that still fails has null vectors, so that its rows stay pending, and after ``FAILURES`` such batches in
    a row the task fails. Any other error fails it at once.
    """
    rows = upsert.pending(papers, model) if "embedding" in papers.columns else papers
    texts = rows.select(F.col(key), document_text(F.col(title), F.col(abstract)).alias("text")).where("text <> ''")

    def tried(part: list[str]) -> list[list[float]] | Exception:
        for k in range(attempts):
            try:
                return embed(part)
            except skipped as error:
                last = error
                if k + 1 < attempts:
                    time.sleep(wait * 2**k)
        return last

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = tried(part["text"].tolist())
                failed = failed + 1 if isinstance(vectors, Exception) else 0
                if failed >= FAILURES:
                    raise RuntimeError(f"{failed} batches in a row failed") from vectors
                if failed:
                    yield pd.DataFrame({key: part[key], "embedding": [None] * len(part)})
                    continue
                if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
                    raise ValueError(f"the embedder must give {len(part)} vectors of {dim} numbers")
                yield pd.DataFrame({key: part[key], "embedding": [np.asarray(v, np.float32) for v in vectors]})

    kind = papers.schema[key].dataType.simpleString()
    return texts.mapInPandas(run, f"{key} {kind}, embedding array<float>").withColumn("embedding_model", F.when(F.col("embedding").isNotNull(), model))


def store_vectors(papers: DataFrame, vectors: DataFrame, key: str = "arxiv_id", now=None) -> DataFrame:
    """``papers`` with the vectors that were made; rows of skipped batches stay as they are."""
    stamped = vectors.where("embedding is not null").withColumn("embedding_updated_at", F.current_timestamp() if now is None else now)
    return upsert.update_columns(papers, stamped, key)


def pieces(text: Column, size: int, overlap: int) -> Column:
    """A text in consecutive pieces of ``size`` characters, each with the last ``overlap`` ones of the piece before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda at: F.substring(text, at + 1, size))


def extract_concepts(papers: DataFrame, done: DataFrame, complete: Callable[[list[tuple[str, str]]], str], *, key: str = "paper_id", text: str = "abstract", batch: int = 20, size: int = 1200, overlap: int = 200, limit: int | None = None) -> DataFrame:
    """paper_id and concepts of the papers that ``done`` (paper_id) lacks.

    ``complete`` gets ``batch`` pairs of an id and at most ``size`` characters and answers with JSON, as
    ``concepts.parse_response`` reads it. Longer texts come in overlapping pieces, whose answers are united in order, so
    names of up to ``overlap`` characters are seen wherever they stand; with ``limit``, only so many characters are
    read. A paper keeps its first ``concepts.PER_PAPER`` concepts. Papers without an answer come with an empty list, so that they are not asked for again.
    """
    whole = F.col(text) if limit is None else F.substring(text, 1, limit)
    todo = papers.where(F.col(text) != "").join(done.select(key).distinct(), key, "left_anti").select(F.col(key).cast("string").alias(key), F.posexplode(pieces(whole, size, overlap)).alias("piece", "text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                ids = [f"{i}#{n}" for i, n in zip(part[key], part["piece"], strict=True)]
                yield pd.DataFrame({"raw": [complete(list(zip(ids, part["text"], strict=True)))], "ids": [ids]})

    asked = todo.mapInPandas(run, "raw string, ids array<string>")
    answers = concepts.parse_response(asked, per_paper=None)
    named = answers.select(F.regexp_replace("paper_id", "#\\d+$", "").alias("paper_id"), F.regexp_extract("paper_id", "#(\\d+)$", 1).cast("int").alias("piece"), F.posexplode("concepts").alias("n", "c"))
    first = named.withColumn("key", casefold(F.col("c.name"))).groupBy("paper_id", "key").agg(F.min(F.struct("piece", "n", "c")).alias("f"))
    united = first.groupBy("paper_id").agg(F.slice(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["c"]), 1, concepts.PER_PAPER).alias("concepts"))
    every = papers.where(F.col(text) != "").join(done.select(key).distinct(), key, "left_anti").select(F.col(key).cast("string").alias("paper_id")).distinct()
    return every.join(united, "paper_id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<struct<name:string,type:string>>")))


def store_concepts(known: DataFrame, links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New versions of concepts (id, name, key) and links (paper_id, concept_id); a known spelling stays."""
    named = found.select("paper_id", F.posexplode("concepts").alias("n", "c")).select("paper_id", "n", F.col("c.name").alias("name")).withColumn("key", casefold(F.col("name")))
    concepts_ = upsert.with_ids(known, named, "key", "name", ["paper_id", "n"])
    new = named.join(concepts_.select(F.col("id").alias("concept_id"), "key"), "key").select("paper_id", "concept_id").distinct()
    return concepts_, links.unionByName(new.join(links, ["paper_id", "concept_id"], "left_anti"))


def frequent_terms(docs: DataFrame, low: int, high: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """paper_id and term for terms that between ``low`` and ``high`` documents have: concepts without a model."""
    terms = docs.select(F.col(doc_id).alias("paper_id"), F.explode(F.array_distinct(bm25_tokens(F.col(text)))).alias("term"))
    band = terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(low, high))
    return terms.join(band.select("term"), "term").select("paper_id", "term")


def run_stages(stages: list[tuple[str, Callable[[], object]]]) -> list[str]:
    """Runs every stage; a failure becomes a warning and does not stop the others."""
    warnings = []
    for name, stage in stages:
        try:
            stage()
        except Exception as error:  # noqa: BLE001  the warning tells
            warnings.append(f"{name}: {error}")
    return warnings


def finish(runs: DataFrame, run_id: int, status: str, warnings: list[str], at) -> DataFrame:
    """The log with one run ended; warnings are joined and cut at 2000 characters."""
    mine = F.col("id") == run_id
    message = "; ".join(warnings)[:2000] or None
    return runs.withColumn("status", F.when(mine, F.lit(status)).otherwise(F.col("status"))).withColumn("completed_at", F.when(mine, at).otherwise(F.col("completed_at"))).withColumn("error_message", F.when(mine, F.lit(message).cast("string")).otherwise(F.col("error_message")))


def status(runs: DataFrame, now) -> DataFrame:
    """The latest run, how long it took or has taken so far, and the window it is in."""
    return upsert.latest_run(runs).select("id", "status", (F.unix_timestamp(F.coalesce("completed_at", now)) - F.unix_timestamp("started_at")).alias("elapsed_seconds"), F.col("last_checkpoint.current.date_window").alias("current_window"))
