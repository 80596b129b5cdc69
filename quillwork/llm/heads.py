"""Comparing many documents with few: the text of a head goes once to each block of its members, never into each pair."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, tidy
from .storage import Scratch, holding


_RUNS = ("array<struct<start:int,end:int>>", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
#: Spark's and Arrow's types of what comparisons give.
TYPES = {"alike": ("double", pa.float64()), "spans": _RUNS, "exact": _RUNS}


def against_heads(
    scratch: Scratch, pairs: DataFrame, docs: DataFrame, prepare: Callable[[pa.Array], list], compare: Callable[[object, object], dict | None], columns: list[str], block: int = 256
) -> DataFrame:
    """Rows (id, row, head, and what ``compare`` gives) for the pairs (id, head) of documents in ``docs`` (row, id, text).

    ``prepare`` turns texts into what is compared; ``compare`` takes it of a document and of its head, and gives the
    values of ``columns`` (of those in ``TYPES``), or None for no row. A document of several texts counts with each.
    Members of a head come in blocks of about ``block``, which keeps popular heads in many tasks.
    """
    sizes = scratch.cut(pairs.groupBy("head").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    placed = scratch.cut(pairs.join(sizes, "head").select("id", "head", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")))
    heads = placed.select(F.col("head").alias("id"), "head", "block", F.lit(False).alias("member")).distinct()
    wanted = scratch.cut(placed.withColumn("member", F.lit(True)).unionAll(heads.select("id", "head", "block", "member")))
    dealt = holding(docs, "id", wanted, "id").join(wanted, "id").select("head", "block", "member", "id", "row", "text")
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("head", pa.int64()), *((c, TYPES[c][1]) for c in columns)])

    @tidy
    def run(batches):
        at, own = None, []
        for batch in batches:
            for start, stop in chunks(batch.column(5)):
                part = batch.slice(start, stop - start)
                made = prepare(part.column(5))
                head, piece = part.column(0).to_numpy(), part.column(1).to_numpy()
                member = part.column(2).to_numpy(zero_copy_only=False)
                out = []
                for k in range(len(made)):
                    if (head[k], piece[k]) != at:
                        at, own = (head[k], piece[k]), []
                    if not member[k]:
                        own.append(made[k])
                        continue
                    for other in own:
                        if (got := compare(made[k], other)) is not None:
                            out.append({"id": part.column(3)[k].as_py(), "row": part.column(4)[k].as_py(), "head": int(head[k]), **got})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.repartition("head", "block").sortWithinPartitions("head", "block", "member").mapInArrow(run, ", ".join(["id long", "row long", "head long", *(f"{c} {TYPES[c][0]}" for c in columns)]))


def slices(doc: np.ndarray, n: int, *columns: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """``columns`` cut at the documents 0 to n - 1 that sorted ``doc`` numbers."""
    cuts = np.searchsorted(doc, np.arange(n + 1))
    return [tuple(c[i:j] for c in columns) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
