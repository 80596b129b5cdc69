"""Best-fit-decreasing packing of token ids into rows of fixed length (operator 9).

Documents are dealt to blocks of bounded size by a hash, so that each block packs by itself. Within a block,
segments go from the longest to the shortest into the open row with the least room that holds them; a segment
tree over room sizes finds it. Documents longer than a row are split; every token is kept.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, fresh

SCHEMA = "block long, row int, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, doc_starts array<int>"


@lru_cache(2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(df: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and binary ids (little-endian unsigned 32-bit) of every whole text; a null text has no ids."""

    def run(batches):
        own = tokenizer(path, pattern)
        for batch in batches:
            for start, stop in chunks(batch.column(1)):
                texts = pc.fill_null(batch.column(1).slice(start, stop - start), "").to_pylist()
                ids = pa.array([np.array(own.encode_ordinary(t), "<u4").tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), ids], names=["doc_id", "ids"])

    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, ids binary")


class Rooms:
    """A segment tree over 0 to ``length``: which room sizes have open rows."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, n: int) -> None:
        k = room + self.size
        while k:
            self.tree[k] += n
            k >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The open row with the least room of at least ``least``, taken out."""
        k, tree = least + self.size, self.tree
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        room = k - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of segment numbers; sizes are from 1 to ``length``."""
    rooms, rows = Rooms(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        if found := rooms.take(n):
            row, room = found
            rows[row].append(i)
        else:
            row, room = len(rows), length
            rows.append([i])
        if room > n:
            rooms.put(row, room - n)
    return rows


def blocks_for(df: DataFrame, text: str = "text", block_bytes: int = 2 << 20) -> int:
    """Blocks of about ``block_bytes`` of text, which is at least as long as its tokens are many."""
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first().n or 0
    return max(1, -(-total // block_bytes))


def pack(df: DataFrame, length: int = 2048, *, ids: str = "ids", doc_id: str = "doc_id", pad_id: int = 0, blocks: int) -> DataFrame:
    """Rows of ``length`` token ids from the documents' binary ``ids`` (little-endian unsigned 32-bit).

    ``blocks`` is how many blocks to deal the documents to, see ``blocks_for``; each is packed in one task.

    Per row: ``block`` and ``row`` (its key), ``ids`` (``length`` ids as 32-bit integers, padded with ``pad_id``),
    ``n_tokens``, ``cu_seqlens`` (where segments start, then the end), ``positions`` (16- or 32-bit integers that
    restart at 0 with each segment and in the padding), and for each segment its document and where in the
    document it starts. Documents without tokens (null or empty ids) take no place. Repeated rows are packed as
    often as they come; columns besides the two named are ignored; an empty table gives no rows.
    """
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{ids}`").alias("ids")).where(F.octet_length("ids") > 0)
    hashed = fresh(source, "block")
    # with the input's partition, which keeps repeated rows apart and is the same when a task runs again
    dealt = source.withColumn(hashed, F.pmod(F.xxhash64("doc_id", "ids", F.spark_partition_id()), F.lit(blocks)))
    places = np.uint16 if length <= 1 << 16 else np.uint32

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        docs = table["doc_id"].to_pylist()
        tokens = [np.frombuffer(x.as_buffer(), "<u4") for x in table["ids"].combine_chunks()]
        cuts = [(d, start) for d, t in enumerate(tokens) for start in range(0, len(t), length)]
        sizes = np.array([min(length, len(tokens[d]) - start) for d, start in cuts])
        out = {name: [] for name in ("row", "n_tokens", "n_segments", "ids", "cu_seqlens", "positions", "doc_ids", "doc_starts")}
        for row, segments in enumerate(best_fit(sizes, length)):
            line, place, ends = np.full(length, pad_id, "<u4"), np.zeros(length, places), np.cumsum([0, *sizes[segments]])
            for i, start, end in zip(segments, ends[:-1], ends[1:], strict=True):
                d, at = cuts[i]
                line[start:end] = tokens[d][at : at + end - start]
                place[start:end] = np.arange(end - start)
            place[ends[-1] :] = np.arange(length - ends[-1])
            values = (row, int(ends[-1]), len(segments), line.tobytes(), ends.tolist(), place.tobytes(), [docs[cuts[i][0]] for i in segments], [cuts[i][1] for i in segments])
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        block = pa.array([table[hashed][0].as_py()] * len(out["row"]), pa.int64())
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.table([block, *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["block", *out])

    return dealt.groupBy(hashed).applyInArrow(run, SCHEMA)


def unpack(packed: DataFrame) -> DataFrame:
    """The documents' ids back from packed rows: doc_id, start (of each segment in its document) and ids."""
    segments = F.arrays_zip("doc_ids", "doc_starts", F.slice("cu_seqlens", 1, F.size("doc_ids")).alias("at"), F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("end"))
    parts = packed.select("ids", F.explode(segments).alias("s"))
    return parts.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_starts").alias("start"), F.expr("substring(ids, 4 * s.at + 1, 4 * (s.end - s.at))").alias("ids"))
