"""Hybrid retrieval and gated question answering."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions.vectors import cosine
from ..operators import bm25, concepts, dense, fusion

NO_MATCH = "No sufficiently similar documents were found."
LEG = "qid string, leg string, leg_order int, doc_id string, rank int"


@dataclass
class Corpus:
    """What retrieval reads: documents (doc_id, title, text, ...), vectors, a sparse index and the concept graph. Without an
    index or a graph their legs are left out."""

    docs: DataFrame
    vectors: DataFrame
    sparse: bm25.Index | None = None
    graph: concepts.Graph | None = None


def _leg(found: DataFrame, leg: str, order: int, doc_id: str = "doc_id") -> DataFrame:
    return found.select(F.col("qid").cast("string").alias("qid"), F.lit(leg).alias("leg"), F.lit(order).alias("leg_order"), F.col(doc_id).cast("string").alias("doc_id"), "rank")


def hybrid(corpus: Corpus, texts: DataFrame, vectors: DataFrame | None, per_leg: int = 20, graph_top: int = 10, top_n: int = 20, max_query: int | None = None) -> DataFrame:
    """qid, doc_id, rrf, source, rank, sim and overlap for queries given as texts (qid, query) and vectors (qid, embedding).

    A query may have several texts and vectors (its variants); a document's best score counts. ``sim`` is the similarity to the
    leading vector: the one with the least ``variant``, a column of ``vectors``; without that column, or on ties, the least
    vector. With ``max_query`` only so many characters of a text are searched for.
    Without vectors, index or concept graph the other legs carry on. Ids first, attributes later: no text goes through the ranking.
    """
    texts = texts.select("qid", "query" if max_query is None else F.substring("query", 1, max_query).alias("query"))
    spark = texts.sparkSession
    legs = spark.createDataFrame([], LEG)
    if corpus.sparse is not None:
        variants = texts.withColumn("variant", F.concat_ws("\x1f", F.col("qid").cast("string"), F.xxhash64("query").cast("string")))
        sparse = bm25.search(corpus.sparse, variants, per_leg, "variant").select(F.split("qid", "\x1f")[0].alias("qid"), "doc_id", "score")
        legs = legs.unionByName(_leg(bm25.best_of_variants(sparse, per_leg), "sparse", 1))
    sims = None
    if vectors is not None:
        many = vectors.select("qid", "embedding").withColumn("variant", F.concat_ws("\x1f", F.col("qid").cast("string"), F.xxhash64("embedding").cast("string")))
        near = dense.search(corpus.vectors, many, per_leg, query_id="variant").select(F.split("qid", "\x1f")[0].alias("qid"), "doc_id", "score")
        legs = legs.unionByName(_leg(bm25.best_of_variants(near, per_leg), "dense", 0))
    overlap = None
    if corpus.graph is not None:
        walked = concepts.traverse(corpus.graph.links, corpus.graph.edges, texts.select("qid", F.col("query").alias("text")), graph_top)
        legs = legs.unionByName(_leg(walked, "graph", 2, "paper_id"))
        overlap = walked.select(F.col("qid").cast("string").alias("qid"), F.col("paper_id").cast("string").alias("doc_id"), F.col("total").alias("overlap"))
    fused = fusion.rrf(legs, top_n)
    if vectors is not None:
        # similarity of the few fused documents to the leading vector of their query
        order = F.struct("variant", "embedding") if "variant" in vectors.columns else F.col("embedding")
        first = vectors.where("embedding is not null").groupBy(F.col("qid").cast("string").alias("qid")).agg(F.min_by("embedding", order).alias("q"))
        own = corpus.vectors.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("embedding").alias("v"))
        sims = fused.select("qid", "doc_id").join(first, "qid").join(own, "doc_id").select("qid", "doc_id", cosine(F.col("v"), F.col("q")).alias("sim"))
    out = fused.join(sims, ["qid", "doc_id"], "left") if sims is not None else fused.withColumn("sim", F.lit(None).cast("double"))
    out = out.withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    return out.join(overlap, ["qid", "doc_id"], "left") if overlap is not None else out.withColumn("overlap", F.lit(None).cast("long"))


def hydrate(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Attributes of found documents; those that are gone drop out. An attribute named like a column of ``found`` gets ``doc_`` in front."""
    taken = {c.lower() for c in found.columns} - {"doc_id"}
    own = docs.select(*[F.col(f"`{c}`").alias(f"doc_{c}" if c.lower() in taken else c) for c in docs.columns])
    return found.join(own.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id")


def search(corpus: Corpus, texts: DataFrame, vectors: DataFrame | None = None, top_k: int = 10, max_query: int | None = None) -> DataFrame:
    """Retrieval alone: the ``top_k`` documents of each query with their attributes, ranked anew from 1 without gaps."""
    if top_k < 1:
        raise ValueError("top_k must be 1 or more")
    found = hydrate(hybrid(corpus, texts, vectors, max_query=max_query), corpus.docs)
    order = Window.partitionBy("qid").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


@dataclass
class Answer:
    answer: str
    docs: list
    confidence: str
    iterations: int
    faithful: bool | None = None
    #: Identifiers of kept documents that the answer cites.
    cited: list[str] = field(default_factory=list)


def prompt(docs: list, contexts: list[str] | None = None) -> str:
    """Numbered blocks of title and text, or of the shortened texts in ``contexts``."""
    said = contexts or [d["text"] for d in docs]
    return "\n\n".join(f"[{k}] {d['title']}\n{t}" for k, (d, t) in enumerate(zip(docs, said, strict=True), 1))


def rewrite_prompt(question: str, last: str) -> str:
    """Asks for another search query after one that found nothing."""
    return f"Question: {question}\nA search for this found nothing: {last}\nAnother search query, in other words:"


def check_prompt(answer: str, docs: list) -> str:
    """Asks whether the documents support an answer."""
    return f"Answer: {answer}\n\nDocuments:\n{prompt(docs)}\n\nWhich claims of the answer do the documents not support?"


def generated(raw: str | dict, docs: list, trim: str | None = None) -> tuple[str, list[str]]:
    """The text of an answer and the kept documents that it cites. ``trim``: what is taken from the ends of the text, white space
    unless stated.

    A structured answer (``answer`` and ``cited``) names them; a plain text, or one with an empty ``answer``, cites them inline.
    """
    said = raw if isinstance(raw, dict) else {"answer": raw}
    answer = (said.get("answer") or "").strip(trim)
    named = said.get("cited") or re.findall(text.CITATION, answer)
    known = {str(d["doc_id"]) for d in docs}
    ids = [m.group(0) if (m := re.search(r"\d{4}\.\d{4,5}", x)) and x not in known else x.strip() for x in map(str, named)]
    return answer, [i for i in dict.fromkeys(ids) if i in known]


def ask(
    question: str,
    retrieve: Callable[[str], DataFrame],
    generate: Callable[[str, str], str | dict],
    *,
    rewrite: Callable[[str, str], str] | None = None,
    faithful: Callable[[str, str], bool] | None = None,
    top_k: int = 5,
    threshold: float = fusion.LOW,
    max_iterations: int = 2,
) -> Answer:
    """One question: retrieve, rewrite the query once if nothing is near, keep what clears the threshold, answer.

    ``retrieve`` gives a frame of at most a few dozen rows with doc_id, sim, rank, title and text; steps before and after it are
    functions that the caller wraps around these callables. Without a document above the
    threshold the generator is not called. A failing check of faithfulness leaves None.
    """
    if not question.strip():
        raise ValueError("the question is blank")
    if not 1 <= top_k <= 20:
        raise ValueError("top_k must be from 1 to 20")
    query, last, n = question, question, 0
    while True:
        found = [r.asDict() for r in retrieve(query).orderBy("rank").limit(20).collect()]
        best = max((d["sim"] or 0.0 for d in found), default=None)
        n += 1
        if best is not None and best >= threshold or n >= max_iterations or rewrite is None:
            break
        new = (rewrite(question, last) or "").strip()
        if not new or new == query:
            break
        last, query = query, new
    kept = [d for d in found if (d["sim"] or 0.0) >= threshold][:top_k]
    if not kept:
        return Answer(NO_MATCH, [], "none", n)
    answer, cited = generated(generate(question, prompt(kept)), kept)
    try:
        held = faithful(answer, prompt(kept)) if faithful else None
    except Exception:  # noqa: BLE001  the check is best effort
        held = None
    top = max(d["sim"] for d in kept)
    return Answer(answer, kept, "high" if top >= fusion.HIGH else "medium" if top >= fusion.MEDIUM else "low", n, held, cited)
