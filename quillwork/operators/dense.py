"""Dense retrieval: exact cosine top-k, and a coarse index of centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine, norm
from . import best
from .bm25 import rank

#: Query vectors go to every task; with more bytes than that they are searched in several passes.
QUERY_BYTES = 8 << 20
#: A task holds so many of the best rows of all its queries.
BEST_ROWS = 500_000


def search(vectors: DataFrame, queries: DataFrame, top_k: int = 20, *, doc_id: str = "doc_id", embedding: str = "embedding", query_id: str = "qid") -> DataFrame:
    """qid, doc_id, score and rank: the ``top_k`` nearest vectors of every stated query vector, ties by document.

    A set of queries is compared with all rows, by products of matrices on the workers; a task keeps the best of each query.
    A set above ``QUERY_BYTES``, or whose best are more than ``BEST_ROWS``, is cut into blocks. Zero vectors and nulls are near
    nothing, and so are vectors of different lengths.
    """
    if top_k < 1:
        raise ValueError("top_k must be 1 or more")
    return _compared(vectors.select(F.col(doc_id).alias("doc_id"), F.col(embedding).alias("v")), _asked(queries, query_id, embedding), top_k)


def _asked(queries: DataFrame, query_id: str, embedding: str) -> DataFrame:
    return queries.select(F.col(query_id).alias("qid"), F.col(embedding).cast("array<double>").alias("q"), norm(F.col(embedding)).alias("nq")).where("nq > 0")


def _compared(rows: DataFrame, asked: DataFrame, top_k: int, lists: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The best of rows (doc_id, v and, with ``lists``, list) for queries (qid, q, nq). ``lists`` says of unit vectors in which lists
    they look: queries x lists."""
    spark, kind = rows.sparkSession, rows.schema["doc_id"]
    named = rows.withColumn("nv", norm(F.col("v"))).where("nv > 0").select("doc_id", "v", "nv", *(["list"] if lists else []))
    size = asked.agg(F.sum(8 * F.size("q") + 64).alias("bytes"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(size.bytes or 0) // QUERY_BYTES), -(-size.n * top_k // BEST_ROWS))
    names = T.StructType([*asked.select("qid").schema, T.StructField("n", T.IntegerType())])
    schema = T.StructType([T.StructField("n", T.IntegerType()), kind, T.StructField("score", T.DoubleType())])
    found = None
    for block in range(blocks):
        table = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)).toArrow()
        groups = []
        for width in np.unique(lengths := pc.list_value_length(table["q"]).to_numpy()) if table.num_rows else ():
            n = np.nonzero(lengths == width)[0]
            part = table.take(pa.array(n))
            q = _matrix(part["q"].combine_chunks(), int(width)) / part["nq"].to_numpy()[:, None]
            groups.append((n.astype(np.int32), q, lists(q) if lists else None))
        near = named.mapInArrow(_nearest_rows(spark.sparkContext.broadcast(groups), top_k), schema)
        own = spark.createDataFrame(pa.table({"qid": table["qid"], "n": pa.array(range(table.num_rows), pa.int32())}), names)
        part = near.join(F.broadcast(own), "n").select("qid", "doc_id", "score")  # a block of queries
        found = part if found is None else found.unionAll(part)
    return rank(found, top_k)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class _Near(best.Best):
    """The nearest vectors so far of each query (a row of ``q``); ``look``: in which lists it looks."""

    def __init__(self, n: np.ndarray, q: np.ndarray, look: np.ndarray | None, top_k: int):
        super().__init__(n, top_k)
        self.q, self.look = q, look

    def add(self, ids: np.ndarray, x: np.ndarray, lists: np.ndarray | None) -> None:
        if self.look is not None and self.look.mean() < 0.25:  # few queries look in a list: these alone
            for k in np.unique(lists):
                if k < self.look.shape[1] and len(own := np.nonzero(self.look[:, k])[0]):
                    self._compare(ids[lists == k], x[lists == k], own, None)
        else:
            self._compare(ids, x, np.arange(len(self.q)), lists)

    def _compare(self, ids: np.ndarray, x: np.ndarray, own: np.ndarray, lists: np.ndarray | None) -> None:
        q = self.q if len(own) == len(self.q) else self.q[own]
        step = max(64, best.CELLS // len(q))
        for at in range(0, len(x), step):
            scores = q @ x[at : at + step].T
            if lists is not None and self.look is not None:
                scores[~self.look[:, lists[at : at + step]]] = -np.inf
            self.offer(own, ids[at : at + step], scores)


def _nearest_rows(held, top_k: int):
    """Of (doc_id, v, nv[, list]) the ``top_k`` best of each query in this task: n, doc_id and score."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, kind = [_Near(n, q, look, top_k) for n, q, look in held.value], None
        for batch in batches:
            kind, widths = batch.column(0).type, pc.list_value_length(batch.column(1)).to_numpy()
            for top in tops:
                own = batch if (widths == top.q.shape[1]).all() else batch.filter(pa.array(widths == top.q.shape[1]))
                if own.num_rows:
                    top.add(best.values(own.column(0)), _matrix(own.column(1), top.q.shape[1]) / own.column(2).to_numpy()[:, None], own.column(3).to_numpy() if batch.num_columns > 3 else None)
        for top in tops:
            yield from top.result(kind)

    return compare


def coarse_index(vectors: DataFrame, lists: int, *, doc_id: str = "doc_id", embedding: str = "embedding", sample_rows: int = 100_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(doc_id, embedding, list) of every vector, and (list, centroid).

    Centroids are fitted on at most about ``sample_rows`` unit vectors; every vector is indexed.
    """
    unit = vectors.where(F.col(embedding).isNotNull()).withColumn("n", norm(F.col(embedding))).where("n > 0").select(F.col(doc_id).alias("doc_id"), F.col(embedding).alias("embedding"), F.transform(embedding, lambda x: x.cast("double") / F.col("n")).alias("unit"))
    rows = unit.withColumn("features", array_to_vector("unit"))
    total = rows.count()
    sample = rows if total <= sample_rows else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / total))
    model = KMeans(k=lists, seed=seed, featuresCol="features", predictionCol="list").fit(sample)
    centroids = vectors.sparkSession.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())], "list int, centroid array<double>")
    return model.transform(rows).select("doc_id", "embedding", "list"), centroids


def probe(index: DataFrame, centroids: DataFrame, queries: DataFrame, top_k: int = 20, probes: int | None = None, *, embedding: str = "embedding", query_id: str = "qid") -> DataFrame:
    """As ``search``, but only among the vectors of each query's ``probes`` nearest lists.

    By default these are three quarters of the lists: vectors spread evenly in 64 dimensions need so many for a recall
    of 0.9; clustered ones need a tenth (tests measure both).
    """
    held = sorted((r.list, r.centroid) for r in centroids.collect())  # as many as lists
    if probes is None:
        probes = -(-3 * len(held) // 4)
    if probes < 1:
        raise ValueError("probes must be 1 or more")
    middle = np.array([c for _, c in held], np.float64).reshape(len(held), -1)
    length = np.sqrt((middle * middle).sum(axis=1))

    def lists(q: np.ndarray) -> np.ndarray:
        look = np.zeros((len(q), max((k for k, _ in held), default=0) + 1), bool)
        if q.shape[1] == middle.shape[1]:
            near = np.where(length > 0, np.round(q @ middle.T / np.maximum(length, 1e-300), 9), -np.inf)
            for at, row in enumerate(np.argsort(-near, axis=1, kind="stable")[:, :probes]):
                look[at, [held[k][0] for k in row if near[at, k] > -np.inf]] = True
        return look

    return _compared(index.select("doc_id", F.col("embedding").alias("v"), "list"), _asked(queries, query_id, embedding), top_k, lists)


@dataclass
class Codes:
    """``rows`` (doc_id, embedding, list, code): a code has a byte for each of the parts of a unit vector's distance from its list's
    centroid. ``books`` has what each byte stands for: parts x 256 x components."""

    rows: DataFrame
    books: np.ndarray
    centroids: np.ndarray

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as unit rows, padded with zeros."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


def _book(x: np.ndarray, rng: np.random.Generator, size: int = 256, rounds: int = 12) -> np.ndarray:
    """``size`` centres of the rows of a bounded sample."""
    c = x[rng.choice(len(x), size, replace=len(x) < size)]
    for _ in range(rounds):
        own = _nearest(x, c)
        count = np.bincount(own, minlength=size)
        total = np.stack([np.bincount(own, x[:, k], size) for k in range(x.shape[1])], axis=1)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), size)])
    return c


def quantise(index: DataFrame, centroids: DataFrame, parts: int = 16, sample_rows: int = 20_000, seed: int = 0) -> Codes | None:
    """Codes of a ``coarse_index``: residuals are cut into ``parts``, each coded by the nearest of 256 centres.

    The centres are fitted on at most ``sample_rows`` vectors; every vector is coded. None for an empty index.
    """
    held = sorted((r.list, r.centroid) for r in centroids.collect())  # as many as lists
    total = index.count()
    if not total:
        return None
    drawn = index if total <= sample_rows else index.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * 0.9 * sample_rows / total))
    table = drawn.select("embedding", "list").limit(sample_rows).toArrow()
    width = -(-len(held[0][1]) // parts) * parts
    middle = np.zeros((max(k for k, _ in held) + 1, width))
    for k, c in held:
        middle[k, : len(c)] = c
    rest = _units(table["embedding"].combine_chunks(), width) - middle[table["list"].to_numpy()]
    rng = np.random.default_rng(seed)
    books = np.stack([_book(x, rng) for x in np.split(rest, parts, axis=1)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                left = _units(part.column(1), width) - middle[part.column(2).to_numpy()]
                made = np.stack([_nearest(x, b) for x, b in zip(np.split(left, parts, axis=1), books, strict=True)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in made], pa.binary())], names=["doc_id", "embedding", "list", "code"])

    rows = index.select("doc_id", "embedding", "list")
    return Codes(rows.mapInArrow(code, T.StructType([*rows.schema, T.StructField("code", T.BinaryType())])), books, middle)


def search_codes(codes: Codes, queries: DataFrame, top_k: int = 20, probes: int | None = None, short: int = 10, *, embedding: str = "embedding", query_id: str = "qid") -> DataFrame:
    """As ``search``, from codes: the ``short`` x ``top_k`` best by tables of what each byte adds to a query's score, then these few
    by their vectors. ``probes``: only in each query's nearest lists (by default in all).

    Tables of a block of queries go to the tasks, ``QUERY_BYTES`` at most; a task keeps the best of each query. Codes and vectors
    are columns of one table: the first step reads no vector.
    """
    if top_k < 1 or short < 1:
        raise ValueError("top_k and short must be 1 or more")
    spark, books, centroids, width = queries.sparkSession, codes.books, codes.centroids, codes.width
    asked = queries.where(F.col(embedding).isNotNull()).select(F.col(query_id).alias("qid"), F.col(embedding).cast("array<double>").alias("q"), norm(F.col(embedding)).alias("nq")).where("nq > 0")
    n, many = short * top_k, books.shape[0] * books.shape[1] * 4 + len(centroids) * 8
    blocks = max(1, -(-asked.count() * many * 5 // (4 * QUERY_BYTES)))
    schema = T.StructType([T.StructField("n", T.IntegerType()), codes.rows.schema["doc_id"], T.StructField("near", T.DoubleType())])
    found = None
    for block in range(blocks):
        table = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)).toArrow()
        if not table.num_rows:
            continue
        q = _units(table["q"].combine_chunks(), width)
        tables = np.einsum("qpc,pkc->qpk", q.reshape(len(q), books.shape[0], -1), books).astype(np.float32)
        base = q @ centroids.T
        if probes is not None and probes < base.shape[1]:
            base[base < np.partition(base, -probes, axis=1)[:, [-probes]]] = -np.inf
        held = spark.sparkContext.broadcast((tables, base))
        near = codes.rows.select("doc_id", "list", "code").mapInArrow(_scorer(held, n), schema)
        names = spark.createDataFrame(table.append_column("n", pa.array(range(table.num_rows), pa.int32())), T.StructType([*asked.schema, T.StructField("n", T.IntegerType())]))
        few = rank(near.select(F.col("n").alias("qid"), "doc_id", F.col("near").alias("score")), n).select(F.col("qid").alias("n"), "doc_id")
        part = few.join(F.broadcast(names), "n").select("qid", "q", "nq", "doc_id")  # a block of queries
        found = part if found is None else found.unionAll(part)
    if found is None:
        return search(codes.rows.limit(0), queries.limit(0), top_k, embedding=embedding, query_id=query_id)
    met = codes.rows.select("doc_id", "embedding").join(found, "doc_id")
    return rank(met.select("qid", "doc_id", cosine(F.col("embedding"), F.col("q"), None, F.col("nq")).alias("score")).where("score is not null"), top_k)


def _scorer(held, n: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, base = held.value
        best, ids, kind = np.full((len(base), 0), -np.inf), np.zeros((len(base), 0), object), None
        for batch in batches:
            kind = batch.column(0).type
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                near = base[:, part.column(1).to_numpy()]
                for p in range(code.shape[1]):
                    near += tables[:, p, code[:, p]]
                best = np.concatenate([best, near], axis=1)
                ids = np.concatenate([ids, np.broadcast_to(np.array(part.column(0).to_pylist(), object), near.shape)], axis=1)
                if best.shape[1] > n:
                    top = np.argpartition(best, -n, axis=1)[:, -n:]
                    best, ids = np.take_along_axis(best, top, 1), np.take_along_axis(ids, top, 1)
        if kind is not None:
            q, at = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(ids[q, at].tolist(), kind), pa.array(best[q, at])], names=["n", "doc_id", "near"])

    return score
