"""Approximate nearest neighbours by a hierarchical k-means tree (operator 13).

The tree is fitted on a bounded sample; every vector is sorted into a leaf. A query goes through the tree best bin first:
a priority queue holds the nodes seen so far, the one with the nearest centre is opened next. How many leaves are
visited is widened until a sample of queries, compared with all vectors, reaches the wanted recall. Nearness is the largest
inner product: with one more component that gives all vectors the same length, that is the least distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Scratch

#: Queries go to the tasks in blocks of at most so many bytes.
QUERY_BYTES = 8 << 20
FOUND = "query long, id long, score double, leaf int"


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    finite = ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; a shorter one is zero in what it lacks."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    out = np.zeros((len(column), dim))
    size = np.diff(at)
    rows = np.repeat(np.arange(len(column)), size)
    out[rows, np.arange(len(flat)) - at[rows]] = flat
    return out


@dataclass
class Tree:
    """``centre`` of every node, its children from ``child`` on (``n_children`` of them, none for a leaf), and its ``leaf`` number."""

    centre: np.ndarray
    child: np.ndarray
    n_children: np.ndarray
    leaf: np.ndarray
    longest: float

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that makes all as long as the longest."""
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Down to the nearest child, level by level."""
        x, node = self.lifted(x), np.zeros(len(x), np.int64)
        inner = np.arange(len(x))
        while len(inner := inner[self.n_children[node[inner]] > 0]):
            for k in np.unique(node[inner]):
                rows = inner[node[inner] == k]
                span = slice(self.child[k], self.child[k] + self.n_children[k])
                c = self.centre[span]
                node[rows] = span.start + ((c * c).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
        return self.leaf[node]

    def visits(self, q: np.ndarray, least: int, rows: int, sizes: np.ndarray) -> list[list[int]]:
        """The leaves of each query, best bin first: ``least`` of them and more until they hold ``rows`` vectors."""
        c = self.centre
        far = (c * c).sum(axis=1) - 2 * np.column_stack([q, np.zeros(len(q))]) @ c.T  # but for a constant of the query
        children = [range(a, a + n) for a, n in zip(self.child.tolist(), self.n_children.tolist(), strict=True)]
        out = []
        for d in far.tolist():
            heap, found, held = [(0.0, 0)], [], 0
            while heap and (len(found) < least or held < rows):
                _, k = heapq.heappop(heap)
                if children[k]:
                    for j in children[k]:
                        heapq.heappush(heap, (d[j], j))
                else:
                    found.append(int(self.leaf[k]))
                    held += int(sizes[found[-1]])
            out.append(found)
        return out


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Which of at most ``k`` clusters each row is in."""
    c = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        own = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        used = np.unique(own)
        c = np.stack([x[own == j].mean(axis=0) for j in used])
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


def fit(sample: np.ndarray, leaves: int, longest: float, *, branch: int = 8, seed: int = 0) -> Tree:
    """A tree of about ``leaves`` leaves: the node with most of the sample is divided next. Equal vectors are never divided."""
    tree = Tree(np.zeros((0, 0)), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), longest)
    x, rng = tree.lifted(sample), np.random.default_rng(seed)
    centre, child, count = [x.mean(axis=0)], [0], [0]
    heap, n = [(-len(x), 0, np.arange(len(x)))], 1
    while heap and n < leaves:
        _, k, rows = heapq.heappop(heap)
        own = _means(x[rows], branch, rng) if len(rows) > 1 else np.zeros(1, int)
        parts = [rows[own == j] for j in np.unique(own)]
        if len(parts) < 2:
            continue
        child[k], count[k], n = len(centre), len(parts), n + len(parts) - 1
        for part in parts:
            heapq.heappush(heap, (-len(part), len(centre), part))
            centre.append(x[part].mean(axis=0))
            child.append(0)
            count.append(0)
    tree.centre, tree.child, tree.n_children = np.stack(centre), np.array(child), np.array(count)
    tree.leaf = np.where(tree.n_children == 0, np.cumsum(tree.n_children == 0) - 1, -1)
    return tree


class Best:
    """The ``k`` nearest vectors so far of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.size = np.sqrt((vectors * vectors).sum(axis=1))
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.zeros((len(ids), k), np.int64)
        self.leaf = np.zeros((len(ids), k), np.int32)

    def add(self, asked: np.ndarray, ids: np.ndarray, x: np.ndarray, leaf: int) -> None:
        """Compares the queries ``asked`` with vectors of one leaf. What may be among the nearest gets its score component by
        component, so that equal vectors have equal scores whatever stands around them."""
        if len(np.unique(ids)) < len(ids):
            once = np.unique(np.column_stack([ids.astype(np.float64), x]), axis=0, return_index=True)[1]
            ids, x = ids[once], x[once]
        near = self.q[asked] @ x.T
        order = np.argsort(ids, kind="stable")
        first, stop = (np.searchsorted(ids[order], self.ids[asked], side) for side in ("left", "right"))
        for i in np.flatnonzero(stop > first):
            near[i, order[first[i] : stop[i]]] = -np.inf
        bound = self.score[asked, -1]
        if len(ids) > self.k:
            bound = np.maximum(bound, np.partition(near, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        slack = x.shape[1] * 2.0**-49 * self.size[asked] * np.sqrt((x * x).sum(axis=1).max())
        i, j = np.nonzero((near >= (bound - slack)[:, None]) & (near > -np.inf))
        if not len(i):
            return
        score = np.zeros(len(i))
        for c in range(x.shape[1]):
            score += self.q[asked[i], c] * x[j, c]
        met = np.unique(i)
        q = np.concatenate([np.repeat(met, self.k), i])
        s = np.concatenate([self.score[asked[met]].ravel(), score])
        d = np.concatenate([self.found[asked[met]].ravel(), ids[j]])
        at = np.concatenate([self.leaf[asked[met]].ravel(), np.full(len(i), leaf, np.int32)])
        by = np.lexsort((d, -s, q))
        q, s, d, at = q[by], s[by], d[by], at[by]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] != s[:-1]) | (d[1:] != d[:-1]) | ~np.isfinite(s[1:])])
        q, s, d, at = q[new], s[new], d[new], at[new]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        q, place = asked[q[kept]], place[kept]
        self.score[q, place], self.found[q, place], self.leaf[q, place] = s[kept], d[kept], at[kept]

    def rows(self) -> pa.RecordBatch:
        q, at = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[q], self.found[q, at], self.score[q, at], self.leaf[q, at])], names=["query", "id", "score", "leaf"])


@dataclass
class Index:
    """``rows`` (leaf, id, vector), the tree, how many vectors each leaf holds, and how many leaves a query visits at least."""

    rows: DataFrame
    tree: Tree
    sizes: np.ndarray
    dim: int
    least: int = 0
    recall: float = 1.0

    def compare(self, ids: np.ndarray, vectors: np.ndarray, visited: np.ndarray, k: int) -> DataFrame:
        """query, id, score and leaf: the nearest of each task for a bounded block of queries. ``visited`` has, for each leaf,
        a bit for each query."""
        spark, dim = self.rows.sparkSession, self.dim
        block = spark.sparkContext.broadcast((ids, vectors, visited))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, asked, seen = block.value
            best = Best(own, asked, k)
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    leaf, id_ = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                    x = matrix(part.column(2), dim)
                    edge = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]]))
                    for a, b in zip(edge[:-1], edge[1:], strict=True):
                        who = np.flatnonzero(np.unpackbits(seen[leaf[a]], count=len(own)))
                        for at in range(0, len(who), 2048):
                            best.add(who[at : at + 2048], id_[a:b], x[a:b], int(leaf[a]))
            yield best.rows()

        wanted = np.flatnonzero(visited.any(axis=1)).tolist()
        return self.rows.where(F.col("leaf").isin(wanted)).mapInArrow(run, FOUND)

    def calibrate(self, sample: np.ndarray, ids: np.ndarray, k: int, wanted: float) -> None:
        """Widens the visits until these queries have ``wanted`` of their true neighbours, found among all vectors."""
        bits = np.packbits(np.ones((self.tree.leaves, len(ids)), bool), axis=1)
        true = nearest(self.compare(ids, sample, bits, k), k).toArrow().to_pydict()
        every = self.tree.visits(sample, self.tree.leaves, 0, self.sizes)
        place = {int(i): {leaf: n for n, leaf in enumerate(v)} for i, v in zip(ids, every, strict=True)}
        ranks = np.sort([place[q][leaf] for q, leaf in zip(true["query"], true["leaf"], strict=True)]) if true["query"] else np.zeros(1, int)
        self.least = int(ranks[min(len(ranks) - 1, int(np.ceil(wanted * len(ranks))) - 1)]) + 1
        self.recall = float((ranks < self.least).mean())

    def search(self, scratch: Scratch, queries: DataFrame, k: int = 20) -> DataFrame:
        """query, rank, id and score of the ``k`` nearest found for queries (id, vector)."""
        tree, least, sizes, dim = self.tree, self.least, self.sizes, self.dim

        def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    found = tree.visits(matrix(part.column(1), dim), least, k + 1, sizes)
                    seen = np.zeros((len(found), tree.leaves), bool)
                    for row, leaves in zip(seen, found, strict=True):
                        row[leaves] = True
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([v[0] for v in found], pa.int32()), pa.array([x.tobytes() for x in np.packbits(seen, axis=1)], pa.binary())], names=["id", "vector", "first", "seen"])

        blocks = max(1, -(-queries.count() * (8 * dim + 16 + tree.leaves // 8) * 5 // (4 * QUERY_BYTES)))
        led = queries.mapInArrow(traverse, "id long, vector array<double>, first int, seen binary")
        # neighbouring queries share a block, and so leaves
        asked = scratch.cut(led.repartitionByRange(blocks, "first", "id").withColumn("block", F.spark_partition_id()))
        found = None
        for block in range(blocks):
            table = asked.where(F.col("block") == block).select("id", "vector", "seen").toArrow()  # QUERY_BYTES at most
            if table.num_rows:
                seen = np.unpackbits(np.frombuffer(b"".join(table["seen"].to_pylist()), np.uint8).reshape(table.num_rows, -1), axis=1)[:, : tree.leaves]
                part = self.compare(table["id"].to_numpy(), matrix(table["vector"].combine_chunks(), dim), np.packbits(seen.T, axis=1), k)
                found = part if found is None else found.unionAll(part)
        if found is None:
            found = queries.sparkSession.createDataFrame([], FOUND)
        return nearest(found, k)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, ties by id, each id and score once."""
    once = found.groupBy("query", "id", "score").agg(F.min("leaf").alias("leaf"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vectors_of(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    own, v = F.col(f"`{vec_id}`"), F.col(f"`{embedding}`")
    return df.where(own.isNotNull() & usable(v)).select(own.cast("long").alias("id"), v.cast("array<double>").alias("vector"))


def build(scratch: Scratch, vectors: DataFrame, *, k: int = 20, recall: float = 0.95, leaf_rows: int = 256, sample_rows: int = 50_000, calibration: int = 256, branch: int = 8, seed: int = 0) -> Index | None:
    """An index of all of ``vectors`` (id, vector); None if there are none.

    The tree is fitted on at most ``sample_rows`` of them (64 MB at most), with a leaf for ``leaf_rows`` vectors or for 16
    of the sample, and calibrated with at most ``calibration`` of the sample as queries for ``k`` neighbours.
    """
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("longest")).first()
    if not size.n:
        return None
    rows = max(1, min(sample_rows, (64 << 20) // (8 * size.dim)))
    drawn = vectors if size.n <= rows else vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * 0.9 * rows / size.n)).limit(rows)
    held = drawn.toArrow()  # sample_rows at most
    if not held.num_rows:
        held = vectors.limit(rows).toArrow()
    sample, ids, dim = matrix(held["vector"].combine_chunks(), size.dim), held["id"].to_numpy(), size.dim
    tree = fit(sample, max(1, min(size.n // leaf_rows, len(sample) // 16)), size.longest, branch=branch, seed=seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield pa.RecordBatch.from_arrays([pa.array(tree.leaf_of(matrix(part.column(1), dim)), pa.int32()), *part.columns], names=["leaf", "id", "vector"])

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by leaf and id, so that a leaf with many equal vectors is in many files
    stored = scratch.cut(vectors.mapInArrow(assign, "leaf int, id long, vector array<double>").repartitionByRange(parts, "leaf", "id").sortWithinPartitions("leaf"))
    sizes = np.zeros(tree.leaves, np.int64)
    for r in stored.groupBy("leaf").count().collect():  # one row a leaf
        sizes[r.leaf] = r["count"]
    index = Index(stored, tree, sizes, dim)
    pick = np.sort(np.random.default_rng(seed).choice(len(ids), min(calibration, len(ids)), replace=False))
    pick = pick[np.unique(ids[pick], return_index=True)[1]]
    index.calibrate(sample[pick], ids[pick], k, recall)
    return index


def search(df: DataFrame, queries: DataFrame | None = None, top_k: int = 20, *, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = 0.95, **options) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of ``queries`` (by default of ``df``) the ``top_k`` rows of ``df`` of largest
    inner product among those that the tree visits, ties by id; all rows, if there are fewer.

    A row is never its own neighbour, nor is another one with its id. Null ids and vectors that are null, zero or hold null
    or non-finite components take no part; a shorter vector is zero in what it lacks, and
    queries are cut to the longest row. Rows equal in id and vector count
    once; rows that share an id only are different rows, and queries that do are one query of several vectors. Empty tables give an empty result, other columns do not matter.
    ``options`` go to ``build``.
    """
    if top_k < 1 or not 0 < recall <= 1:
        raise ValueError("top_k must be 1 or more, recall above 0 and at most 1")
    spark = df.sparkSession
    vectors = vectors_of(df, vec_id, embedding)
    with Scratch(spark) as scratch:
        index = build(scratch, vectors, k=top_k, recall=recall, **options)
        if index is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        asked = (vectors if queries is None else vectors_of(queries, vec_id, embedding)).select("id", F.slice("vector", 1, index.dim).alias("vector")).distinct()
        found = index.search(scratch, asked, top_k)
        return scratch.result(found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"))
