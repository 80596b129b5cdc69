"""Questions in bulk: a plan of replaceable steps over one table of questions.

A step is a function from the state to the state: one row a question, with ``STATE``'s columns. Models are callables that get
batches on the workers; what they said is held at once, so no plan asks them twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import fusion
from ..sources.tables import kept
from .retrieval import NO_MATCH, generated

DOC = "struct<rank:int,doc_id:string,sim:double,title:string,text:string>"
STATE = f"qid string, question string, query string, iterations int, docs array<{DOC}>, contexts array<string>, confidence string, answer string, cited array<string>, faithful boolean, failed string, retry_after double"
Step = Callable[[DataFrame], DataFrame]
Search = Callable[[DataFrame], DataFrame]
#: Documents that a retrieval keeps for a question.
FOUND = 20


class ServiceError(Exception):
    """A model could not be asked; ``retry_after`` seconds later it may be."""

    kind = "unavailable"

    def __init__(self, message: str = "", retry_after: float = 30.0):
        super().__init__(message)
        self.retry_after = retry_after

    def __reduce__(self):
        return type(self), (str(self), self.retry_after)


class Unavailable(ServiceError):
    """It timed out, is down or rejected the caller."""


class RateLimited(ServiceError):
    """It asks for fewer calls."""

    kind = "rate_limited"


def tried(call: Callable[[list], list], rows: list, attempts: int, longest: float) -> list | ServiceError:
    """What ``call`` says to ``rows``, one thing for each; a service error is tried again after the wait that it asks for, up to
    ``longest`` seconds, and is returned after the last attempt."""
    for k in range(attempts):
        try:
            said = list(call(rows))
        except ServiceError as error:
            last = error
            if k + 1 < attempts:
                time.sleep(min(error.retry_after, longest))
            continue
        if len(said) != len(rows):
            raise ValueError(f"the model must give {len(rows)} answers, not {len(said)}")
        return said
    return last


def start(questions: DataFrame) -> DataFrame:
    """The state of questions (qid, question). Rows that share a qid are one question, the least text; a blank one has failed."""
    one = questions.where("qid is not null").groupBy(F.col("qid").cast("string").alias("qid")).agg(F.min("question").alias("question"))
    blank = F.coalesce(strip(F.col("question")) == "", F.lit(True))
    values = {"qid": F.col("qid"), "question": F.col("question"), "query": F.col("question"), "iterations": F.lit(0), "docs": F.array(), "cited": F.array(), "confidence": F.lit("none"), "failed": F.when(blank, "blank")}
    return one.select(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (c.split(" ", 1) for c in STATE.split(", "))])


def _best() -> Column:
    return F.array_max(F.transform("docs", lambda d: F.coalesce(d["sim"], F.lit(0.0))))


def _replaced(state: DataFrame, new: DataFrame, **columns: Column) -> DataFrame:
    """``state`` joined with ``new`` (qid, ...) and with ``columns`` set."""
    joined = state.join(new, "qid", "left")
    return joined.select(*[columns.get(c, F.col(c)).alias(c) for c in state.columns])


def retrieve(search: Search) -> Step:
    """Documents for every query: ``search`` takes (qid, query) and gives qid, doc_id, sim, rank, title and text."""

    def step(state: DataFrame) -> DataFrame:
        asked = state.where("failed is null")
        found = search(asked.select("qid", "query")).where(F.col("rank") <= FOUND)
        doc = F.struct(F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("string").alias("doc_id"), F.col("sim").cast("double").alias("sim"), F.col("title").cast("string").alias("title"), F.col("text").cast("string").alias("text"))
        listed = found.groupBy(F.col("qid").cast("string").alias("qid")).agg(F.array_sort(F.collect_list(doc)).alias("_docs"))
        fine = F.col("failed").isNull()
        docs = F.when(fine, F.coalesce("_docs", F.array().cast(f"array<{DOC}>"))).otherwise(F.col("docs"))
        return _replaced(state, listed, docs=docs, iterations=F.col("iterations") + fine.cast("int"))

    return step


def _asked(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return kept(rows.mapInArrow(run, schema))


def rewrite(model: Callable[[list[tuple[str, str]]], list[str]], search: Search, threshold: float = fusion.LOW, max_iterations: int = 2, *, batch: int = 16, attempts: int = 3, longest: float = 120.0) -> Step:
    """Other queries for the questions whose best document is below ``threshold``, and documents for these, until each has been
    searched for ``max_iterations`` times. ``model`` gets pairs of a question and its last query. A blank or equal query ends
    it; a question for which the model cannot be asked keeps what it has."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                rows = part.slice(at, batch).to_pylist()
                said = tried(model, [(r["question"], r["query"]) for r in rows], attempts, longest)
                new = [None if isinstance(said, ServiceError) else (s or "").strip() for s in (rows if isinstance(said, ServiceError) else said)]
                yield pa.RecordBatch.from_arrays([pa.array([r["qid"] for r in rows], pa.string()), pa.array(new, pa.string())], names=["qid", "_new"])

    def step(state: DataFrame) -> DataFrame:
        for _ in range(max_iterations - 1):
            state = kept(state)
            low = state.where(F.col("failed").isNull() & (F.coalesce(_best(), F.lit(-1.0)) < threshold))
            said = _asked(low.select("qid", "question", "query"), ask, "qid string, _new string").where("_new <> ''")
            again = low.join(said, "qid").where("_new <> query")
            redone = retrieve(search)(again.withColumn("query", F.col("_new")).drop("_new"))
            state = state.join(again.select("qid"), "qid", "left_anti").unionByName(redone)
        return state

    return step


def gate(threshold: float = fusion.LOW, top_k: int = 5) -> Step:
    """The ``top_k`` documents at or above ``threshold``, and the confidence that the nearest of them gives."""
    if not 1 <= top_k <= FOUND:
        raise ValueError(f"top_k must be from 1 to {FOUND}")

    def step(state: DataFrame) -> DataFrame:
        near = F.slice(F.filter("docs", lambda d: F.coalesce(d["sim"], F.lit(0.0)) >= threshold), 1, top_k)
        band = F.when(F.size("docs") == 0, "none").when(_best() >= fusion.HIGH, "high").when(_best() >= fusion.MEDIUM, "medium").otherwise("low")
        return state.withColumn("docs", near).withColumn("confidence", band)

    return step


def shorten(length: int) -> Step:
    """What the model reads of each document: its first ``length`` characters."""
    return lambda state: state.withColumn("contexts", F.transform("docs", lambda d: F.substring(d["text"], 1, length)))


def prompt() -> Column:
    """Numbered blocks of title and text, or of what a step has put in ``contexts``."""
    said = F.coalesce("contexts", F.transform("docs", lambda d: d["text"]))
    blocks = F.transform("docs", lambda d, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), F.coalesce(d["title"], F.lit("")), F.lit("\n"), F.coalesce(F.get(said, k), F.lit(""))))
    return F.array_join(blocks, "\n\n")


def generate(model: Callable[[list[tuple[str, str]]], list[str | dict]], *, batch: int = 16, attempts: int = 3, longest: float = 120.0, trim: str | None = None) -> Step:
    """Answers to the questions that have documents, and which of these they cite; the others get the fixed answer, and the
    model is not asked. ``model`` gets pairs of a question and its prompt. Where it cannot be asked, ``failed`` says why
    (unavailable, rate_limited) and ``retry_after`` when it may be again; any other error ends the job. ``trim``: characters that
    are taken from the ends of an answer, white space unless stated."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                rows, out = part.slice(at, batch).to_pylist(), []
                said = tried(model, [(r["question"], r["prompt"]) for r in rows], attempts, longest)
                for k, r in enumerate(rows):
                    if isinstance(said, ServiceError):
                        out.append({"qid": r["qid"], "_failed": said.kind, "_after": said.retry_after})
                        continue
                    answer, cited = generated(said[k], [{"doc_id": i} for i in r["ids"]], trim)
                    out.append({"qid": r["qid"], "_answer": answer, "_cited": cited})
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("qid", pa.string()), ("_answer", pa.string()), ("_cited", pa.list_(pa.string())), ("_failed", pa.string()), ("_after", pa.float64())])

    def step(state: DataFrame) -> DataFrame:
        state = kept(state)
        rows = state.where(F.col("failed").isNull() & (F.size("docs") > 0)).select("qid", "question", prompt().alias("prompt"), F.transform("docs", lambda d: d["doc_id"]).alias("ids"))
        said = _asked(rows, ask, "qid string, _answer string, _cited array<string>, _failed string, _after double")
        none = F.col("failed").isNull() & (F.size("docs") == 0)
        return _replaced(state, said, answer=F.when(none, NO_MATCH).otherwise(F.col("_answer")), cited=F.coalesce("_cited", "cited"), failed=F.coalesce("failed", "_failed"), retry_after=F.coalesce("_after", "retry_after"))

    return step


def check(model: Callable[[list[tuple[str, str]]], list[bool]], *, batch: int = 16) -> Step:
    """Whether documents support the answers: ``model`` gets pairs of an answer and its prompt. Any error leaves null."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                rows = part.slice(at, batch).to_pylist()
                try:
                    said = [bool(x) for x in model([(r["answer"], r["prompt"]) for r in rows])]
                    said = said if len(said) == len(rows) else [None] * len(rows)
                except Exception:  # noqa: BLE001  the check is best effort
                    said = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([r["qid"] for r in rows], pa.string()), pa.array(said, pa.bool_())], names=["qid", "_held"])

    def step(state: DataFrame) -> DataFrame:
        state = kept(state)
        rows = state.where("failed is null and size(docs) > 0").select("qid", "answer", prompt().alias("prompt"))
        return _replaced(state, _asked(rows, ask, "qid string, _held boolean"), faithful=F.col("_held"))

    return step


def ask_batch(questions: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """The state of questions (qid, question) after all steps, such as [retrieve, rewrite, gate, generate, check]. Any of them can
    be replaced, left out or joined by others."""
    return kept(reduce(lambda state, step: step(state), steps, start(questions)))
