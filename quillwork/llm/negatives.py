"""Hard negatives by a secondary sort (operator 12).

Scores of an anchor with its nearest rows are packed into keys (anchor, descending score, id), dealt by anchor and sorted
on the way. An iterator reads each anchor's rows as they come: a positive opens a window, and rows of other labels whose
score falls into it are its negatives. Before the shuffle each task keeps only what can be among an anchor's first.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Scratch
from .vector_tree import matrix

#: Anchors go to the tasks in blocks of at most so many bytes.
ANCHOR_BYTES = 8 << 20
#: Rows and anchors that are compared at a time.
ROWS, STRIP = 1024, 2048
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_KEY = ">QQQ"
_TOP, _SIGN = (1 << 63) - 1, 1 << 63


def packed(anchor: np.ndarray, score: np.ndarray, id_: np.ndarray) -> list[bytes]:
    """Keys whose bytes sort by anchor, then falling score, then id."""
    parts = np.stack([anchor.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN), ~(score.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)), id_.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)], axis=1)
    raw = np.ascontiguousarray(parts.astype(">u8")).tobytes()
    return [raw[k : k + 24] for k in range(0, len(raw), 24)]


def unpacked(key: bytes) -> tuple[int, int, int]:
    a, s, i = struct.unpack(_KEY, key)
    return a - _SIGN, _TOP - s, i - _SIGN


def by_anchor(key: bytes) -> int:
    """Where a key is dealt: the same in every worker, and even for ids with a common factor."""
    return hash((struct.unpack_from(">Q", key)[0], 1))


def quantised(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    out = np.floor(np.float64(scale) * matrix(column, dim))
    if not np.isfinite(out).all():
        raise ValueError("a component times the scale is beyond double precision")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; an error where 100 of one pass 64 bits."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    if np.abs(whole).max(initial=0) >= 2**63 // 100:
        raise ValueError("scores are beyond 64 bits: take a smaller scale")
    return whole.astype(np.int64)


class First:
    """The ``k`` best (score, then least id) of each of ``n`` groups so far; an id and score counts once."""

    def __init__(self, n: int, k: int):
        self.k, self.worst = k, np.full(n, np.iinfo(np.int64).min)
        self.group, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        g, s, d = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        by = np.lexsort((d, -s, g))
        g, s, d = g[by], s[by], d[by]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (d[1:] != d[:-1])]) if len(g) else np.zeros(0, bool)
        g, s, d = g[new], s[new], d[new]
        kept = np.arange(len(g)) - np.searchsorted(g, g) < self.k
        self.group, self.score, self.id = g[kept], s[kept], d[kept]
        full = np.flatnonzero(np.bincount(self.group, minlength=len(self.worst)) == self.k)
        last = np.searchsorted(self.group, full, side="right") - 1
        self.worst[full] = self.score[last]


def candidates(rows: DataFrame, block: tuple, dim: int, scale: int, k: int, window: tuple[int, int] | None) -> DataFrame:
    """anchor, score and id of what each task finds for the anchors of a bounded block: without ``window`` the ``k`` best rows
    of an anchor's label, else for each of its positives the ``k`` best rows of other labels in the window."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, positives = held.value
        n, slots = len(ids), 1 if window is None else positives.shape[1]
        first = First(n * slots, k)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                own, label = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                x = quantised(part.column(2), dim, scale)
                for at in range(0, n, STRIP):
                    who = np.arange(at, min(n, at + STRIP))
                    score = products(vectors[who], x)
                    same = labels[who, None] == label[None, :]
                    for slot in range(slots):
                        fits = same & (ids[who, None] != own[None, :]) if window is None else ~same
                        if window is not None:
                            p, there = positives[who, slot, None, 0], positives[who, slot, None, 1] > 0
                            fits &= there & (100 * score <= window[1] * p) & (100 * score >= window[0] * p)
                        group = who * slots + slot
                        i, j = np.nonzero(fits & (score >= first.worst[group][:, None]))
                        if len(i):
                            first.add(group[i], score[i, j], own[j])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[first.group // slots], first.score, first.id)], names=["anchor", "score", "id"])

    return rows.mapInArrow(run, "anchor long, score long, id long")


def keyed(found: DataFrame, positive: bool):
    """An RDD of (packed key, whether it is a positive)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(packed(*(batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))), pa.binary())], names=["key"])

    return found.select("anchor", "score", "id").mapInArrow(pack, "key binary").rdd.map(lambda r: (bytes(r[0]), positive))


def windows(rows: Iterator[tuple[bytes, bool]], negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Negatives of every positive from sorted keys. What is held of an anchor is its open windows, and the first rows of score
    0, which alone can stand before a positive they belong to (one of score 0)."""
    anchor, open_, zeros, last = None, [], [], None
    for key, positive in rows:
        a, s, i = unpacked(key)
        if a != anchor:
            anchor, open_, zeros, last = a, [], [], None
        if positive:
            open_.append([i, s, 0])
            if s == 0:
                for z in zeros:
                    open_[-1][2] += 1
                    yield a, i, open_[-1][2], z, 0, 0
            continue
        if key == last:  # a row that two positives' windows have brought
            continue
        last = key
        if s == 0 and len(zeros) < negatives:
            zeros.append(i)
        for w in open_:
            if w[2] < negatives and low * w[1] <= 100 * s <= high * w[1]:
                w[2] += 1
                yield a, w[0], w[2], i, w[1], s


def mine(df: DataFrame, anchors: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores: for each row that ``anchors`` holds for and each of its first
    ``positives`` other rows of its label, the first ``negatives`` rows of other labels whose score is from ``low`` to
    ``high`` hundredths of the positive's.

    A score is the inner product of whole numbers, floor(``scale`` * component); the higher comes first, ties go by id.
    Rows with a null id, label or vector, or a null or non-finite component, take no part; a shorter vector is zero in
    what it lacks. Rows with the same id and score count once; the anchor's id is no other row; of rows that share an
    anchor's id, the least by label and vector is the anchor. Positives below zero have no window. An empty table gives an
    empty result; other columns do not matter. Scores of which 100 pass 64 bits are an error.
    """
    if min(positives, negatives, scale) < 1 or not 0 <= low <= high < 100:
        raise ValueError("positives, negatives and scale must be 1 or more, and 0 <= low <= high < 100")
    spark = df.sparkSession
    own, v, kind = F.col(f"`{vec_id}`"), F.col(f"`{embedding}`"), F.col(f"`{label}`")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = own.isNotNull() & kind.isNotNull() & v.isNotNull() & finite
    cast = [own.cast("long").alias("id"), kind.cast("long").alias("label"), v.cast("array<double>").alias("vector")]
    rows = df.where(usable).select(*cast)
    chosen = df.where(usable & F.coalesce(anchors, F.lit(False))).select(*cast).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")
    size = rows.agg(F.max(F.size("vector")).alias("dim")).first()
    dim = size.dim or 0
    with Scratch(spark) as scratch:
        n = chosen.count()
        blocks = max(1, -(-n * (8 * dim + 16 + 16 * positives) * 5 // (4 * ANCHOR_BYTES)))
        dealt = scratch.cut(chosen.repartitionByRange(blocks, "id").withColumn("block", F.spark_partition_id()))
        pairs = None
        for block in range(blocks):
            table = dealt.where(F.col("block") == block).toArrow()  # ANCHOR_BYTES at most
            if not table.num_rows:
                continue
            ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
            vectors = quantised(table["vector"].combine_chunks(), dim, scale)
            order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
            near = candidates(rows, (ids, labels, vectors, None), dim, scale, positives, None).distinct()
            first = scratch.cut(near.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives))
            opened = first.select("anchor", "place", "score").toArrow()  # as many as positives for each anchor of the block
            by = np.argsort(ids)
            bounds = np.zeros((len(ids), positives, 2), np.int64)
            at = by[np.searchsorted(ids[by], opened["anchor"].to_numpy())], opened["place"].to_numpy()
            bounds[at] = np.column_stack([opened["score"].to_numpy(), np.ones(opened.num_rows, np.int64)])
            met = candidates(rows, (ids, labels, vectors, bounds), dim, scale, negatives, (low, high))
            part = keyed(first, True).union(keyed(met, False))
            pairs = part if pairs is None else pairs.union(part)
        if pairs is None:
            return spark.createDataFrame([], RESULT)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sorted_ = pairs.repartitionAndSortWithinPartitions(parts, by_anchor)
        return scratch.result(spark.createDataFrame(sorted_.mapPartitions(lambda part: windows(part, negatives, low, high)), RESULT, verifySchema=False))
