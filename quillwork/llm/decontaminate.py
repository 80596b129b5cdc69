"""Benchmark decontamination by greedy string tiling (operator 5).

Windows of ``min_match`` folded words, hashed as in Karp-Rabin search, are the seeds that a text and a benchmark
item share. Seeds next to each other on a diagonal make maximal matches; the longest match whose words are all
free is marked again and again, and what overlaps it is cut down to its free parts. The marked share of the item
is its coverage: passages count wherever and in whatever order they stand in the text.

The benchmark is a stated query set. It goes to the workers in blocks of at most ``block_bytes``, one pass over the
texts for each block, so a benchmark of any size is handled in bounded memory. Passes write hashes of contaminated
texts and their scores, never texts.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import SPACE, Grid, chunks, fresh, grid, shingles, tidy
from .storage import Scratch, split

#: White space and ASCII punctuation stand between words; letter case is folded.
BETWEEN = SPACE.copy()
BETWEEN[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


class Index:
    """Seeds of a block of benchmark items, sorted by hash."""

    def __init__(self, items: list, texts: pa.Array, width: int):
        g = grid(pc.utf8_lower(texts), BETWEEN)
        self.ids, self.sizes, self.width = items, np.diff(g.first), width
        seeds, at = shingles(g.words(), g.doc, width)
        by = np.argsort(seeds, kind="stable")
        self.seeds, at = seeds[by], at[by]
        self.item, self.at = g.doc[at], at - g.first[g.doc[at]]

    def counts(self, seeds: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.seeds, seeds, side="right") - np.searchsorted(self.seeds, seeds, side="left")

    def matches(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a position in ``seeds`` and one in the index with equal hashes."""
        low = np.searchsorted(self.seeds, seeds, side="left")
        n = np.searchsorted(self.seeds, seeds, side="right") - low
        left = np.repeat(np.arange(len(seeds)), n)
        return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def tile(runs: list[tuple[int, int, int]], least: int, size: int) -> int:
    """Words marked by greedy string tiling of an item of ``size`` words. ``runs``: maximal matches as (start in text,
    start in item, length)."""
    heap = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(heap)
    base = min(i for i, _, _ in runs)
    text, item = np.zeros(max(i + n for i, _, n in runs) - base, bool), np.zeros(size, bool)
    done = 0
    while heap and size - done >= least:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = text[i - base : i - base + n] | item[j : j + n]
        if not taken.any():
            text[i - base : i - base + n] = item[j : j + n] = True
            done += n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start >= least:
                heapq.heappush(heap, (start - end, i + start, j + start))
    return done


def diagonals(g: Grid, index: Index, limit: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Maximal runs of seeds that texts and items share: text, item, starts in both and how many seeds.

    Positions are taken in strips of about ``limit`` pairs, so that texts and items of one repeated word, which meet at
    every place, cost time but no memory.
    """
    seeds, at = shingles(g.words(), g.doc, index.width)
    ends = np.cumsum(index.counts(seeds))
    found = []
    low = 0
    while low < len(seeds):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + limit)))
        left, right = index.matches(seeds[low:high])
        left += low
        doc, item = g.doc[at[left]], index.item[right]
        found.append(_runs(doc, item, at[left] - g.first[doc], index.at[right], np.ones(len(doc), np.int64)))
        low = high
    return _runs(*(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(5)))


def _runs(doc: np.ndarray, item: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs that follow each other on a diagonal as one, in order."""
    by = np.lexsort((i, i - j, item, doc))
    doc, item, i, j, n = (x[by] for x in (doc, item, i, j, n))
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + n[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[new], item[new], i[new], j[new], np.add.reduceat(n, new) if len(new) else n


def scan(texts: pa.Array, index: Index, threshold: float) -> list[list[tuple[int, float]]]:
    """For each text, the items that share a seed with it and their coverage."""
    doc, item, i, j, length = diagonals(grid(pc.utf8_lower(texts), BETWEEN), index)
    out: list[list[tuple[int, float]]] = [[] for _ in range(len(texts))]
    if not len(doc):
        return out
    length = length + index.width - 1
    firsts = np.append(np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])), len(doc))
    # no tiling covers more words than its matches have
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        size = int(index.sizes[item[a]])
        if length[a:b].sum() < threshold * size:
            continue
        marked = tile(list(zip(i[a:b].tolist(), j[a:b].tolist(), length[a:b].tolist(), strict=True)), index.width, size)
        out[doc[a]].append((int(item[a]), marked / size))
    return out


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    *,
    item_id: str = "item_id",
    item_text: str = "text",
    min_match: int = 5,
    threshold: float = 0.5,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """``df`` with ``n_items`` (benchmark items of which at least ``threshold`` is tiled by the text), ``best_item``
    (the one with the highest coverage, the lowest id on ties; null if none), ``coverage`` and ``contaminated``.

    Items with fewer than ``min_match`` words are in no text; null texts and null items have no words. Rows are
    judged one by one. An empty benchmark contaminates nothing; an empty table stays empty; columns named like an
    output are replaced.
    """
    new = ("n_items", "best_item", "coverage", "contaminated")
    kept = [c for c in df.columns if c == text or c.lower() not in new]
    docs = df.select(*[F.col(f"`{c}`") for c in kept])
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text")).where("text is not null and id is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks == 1:
        return _pass(docs, text, items, min_match, threshold).withColumn("contaminated", F.col("n_items") > 0)

    h, g = fresh(docs, "_h"), fresh(docs, "_g")
    hashes = [F.xxhash64(F.col(f"`{text}`")).alias(h), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias(g)]
    with Scratch(df.sparkSession) as scratch:
        texts, found = docs.select(F.col(f"`{text}`")), []
        for block in range(blocks):
            held = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
            found.append(scratch.cut(_pass(texts, text, held, min_match, threshold).where("n_items > 0").select(*hashes, *new[:3]).distinct()))
        every = reduce(DataFrame.unionAll, found)
        best = F.max_by("best_item", F.struct("coverage", -F.col("best_item")))
        scores = scratch.keep(scratch.cut(every.groupBy(h, g).agg(F.sum("n_items").alias(new[0]), best.alias(new[1]), F.max("coverage").alias(new[2]))))
    may, others = split(docs.select("*", *hashes), h, scores, h)
    judged = may.join(scores, [h, g], "left").select(*[F.col(f"`{c}`") for c in kept], *new[:3])
    none = others.select(*[F.col(f"`{c}`") for c in kept], *(F.lit(None).cast(t).alias(c) for c, t in zip(new, ("long", "long", "double"), strict=False)))
    out = judged.unionAll(none).withColumn(new[0], F.coalesce(new[0], F.lit(0).cast("long"))).withColumn(new[2], F.coalesce(new[2], F.lit(0.0)))
    return out.withColumn("contaminated", F.col("n_items") > 0)


def _pass(df: DataFrame, text: str, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """``df`` with n_items, best_item and coverage for one block of items (id, text)."""
    kept = df.columns
    held = items.toArrow().sort_by([("id", "ascending"), ("text", "ascending")])  # a block, of bounded size
    index = Index(held["id"].to_pylist(), held["text"].combine_chunks() if held.num_rows else pa.array([], pa.string()), width)
    shared = df.sparkSession.sparkContext.broadcast(index)

    @tidy
    def run(batches):
        index = shared.value
        for batch in batches:
            column = batch.column(kept.index(text))
            for start, stop in chunks(column):
                part = batch.slice(start, stop - start)
                n, best, most = [0] * part.num_rows, [None] * part.num_rows, [0.0] * part.num_rows
                for d, found in enumerate(scan(part.column(kept.index(text)), index, threshold)):
                    held = [(share, -index.ids[item]) for item, share in found if share >= threshold]
                    if held:
                        n[d], (most[d], least) = len(held), max(held)
                        best[d] = -least
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), pa.array(best, pa.int64()), pa.array(most, pa.float64())], names=[*kept, "n_items", "best_item", "coverage"])

    schema = df.select("*", F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("long").alias("best_item"), F.lit(0.0).alias("coverage")).schema
    return df.mapInArrow(run, schema)
