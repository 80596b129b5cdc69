"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (operator 2).

A row's block is a hash of the row. The matrix of how many rows go from each block to each shard is drawn
exactly, from the block sizes alone: (blocks x shards) numbers, whatever the number of rows a block has. Each block
permutes its rows and deals them out by its line of the matrix; each shard permutes what it gets. Permuting is
ranking by a second and third hash, and a shard ranks piece by piece, so no task holds a shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrowtext import fresh


def hypergeometric(good: int, bad: int, drawn: int, rng: np.random.Generator) -> int:
    """How many of ``drawn`` items without replacement are good, by inversion around the mode; for any sizes."""
    least, most = max(0, drawn - bad), min(good, drawn)
    if least == most:
        return least
    total = good + bad
    mode = min(most, max(least, (drawn + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(max(1.0, drawn * (good / total) * (bad / total)))
    low, high = max(least, mode - int(12 * spread) - 40), min(most, mode + int(12 * spread) + 40)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows from each block to each shard: multivariate hypergeometric, block after block, with these sums."""
    rng, left, out = np.random.default_rng(seed), list(shards), []
    for n in blocks:
        line, rest = [], sum(left)
        for room in left[:-1]:
            rest -= room
            line.append(hypergeometric(room, rest, n, rng) if n else 0)
            n -= line[-1]
        out.append([*line, n])
        left = [a - b for a, b in zip(left, out[-1], strict=True)]
    return out


def shard(df: DataFrame, n_shards: int, *, seed: int = 0, block_rows: int = 100_000, least_blocks: int = 256, most_blocks: int = 16_384) -> DataFrame:
    """``df`` with int column ``shard`` and long column ``slot``: a random place for every row.

    Shard sizes differ by one at most (law ``rows``); slots of a shard run from 0 without gaps. The result is a
    function of the rows and ``seed``. Rows equal in all columns share a block and are placed in any order among
    themselves. Nulls hash like any value; an empty table stays empty; columns named like an output are replaced.

    The driver draws the matrix from one count per block: one block for ``block_rows`` rows, ``least_blocks`` at least and
    ``most_blocks`` at most, beyond which blocks grow (they are sorted with spilling). So matrix and broadcast have a
    bound that the table's size does not move. A column of a map type cannot be hashed and raises Spark's error.
    """
    spark = df.sparkSession
    source = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")])
    block, first, piece, rank, begins, bases = (fresh(source, f"_{x}") for x in ("block", "first", "piece", "rank", "begins", "bases"))
    total = source.count()
    n_blocks = min(most_blocks, max(least_blocks, -(-total // block_rows)))
    columns = [F.col(f"`{c}`") for c in source.columns]
    hashed = source.withColumn(first, F.xxhash64(F.lit(seed), F.lit("deal"), *columns))
    hashed = hashed.withColumn(block, F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), F.col(first)), F.lit(n_blocks)).cast("int"))
    sizes = dict(hashed.groupBy(block).count().collect())
    counts = matrix([sizes.get(b, 0) for b in range(n_blocks)], [total // n_shards + (s < total % n_shards) for s in range(n_shards)], seed)
    ends = [(b, np.cumsum(line).tolist()) for b, line in enumerate(counts)]
    plan = spark.createDataFrame(ends, f"`{block}` int, `{begins}` array<long>")
    ranked = hashed.withColumn(rank, F.row_number().over(Window.partitionBy(block).orderBy(first)) - 1)
    # most_blocks x shards numbers at most
    dealt = ranked.join(F.broadcast(plan), block).withColumn("shard", F.size(F.filter(F.col(begins), lambda end: end <= F.col(rank))).cast("int"))

    second = fresh(dealt, "_second")
    pieces = max(4, n_blocks // n_shards)
    dealt = dealt.withColumn(second, F.xxhash64(F.lit(seed), F.lit("place"), F.col(first), F.col(rank)))
    # equal ranges of the hash, in order: ranking within them is ranking within the shard
    dealt = dealt.withColumn(piece, F.floor((F.shiftrightunsigned(second, 32) * F.lit(pieces)) / F.lit(1 << 32)).cast("int")).drop(block, first, rank, begins)
    held = dealt.groupBy("shard", piece).count()
    offsets = held.select("shard", piece, (F.sum("count").over(Window.partitionBy("shard").orderBy(piece)) - F.col("count")).alias(bases))
    unsigned = F.shiftrightunsigned(second, 1)
    placed = dealt.withColumn(rank, F.row_number().over(Window.partitionBy("shard", piece).orderBy(F.shiftrightunsigned(second, 32), unsigned, second)) - 1)
    # shards x pieces numbers: the same bound
    placed = placed.join(F.broadcast(offsets), ["shard", piece]).withColumn("slot", (F.col(bases) + F.col(rank)).cast("long"))
    return placed.select(*[F.col(f"`{c}`") for c in source.columns], "shard", "slot")
