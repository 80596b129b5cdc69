"""Quality rules: word counts, repeated lines and suffix-array repetition (operator 7).

One suffix array over the words of a run of texts gives the longest common prefixes of neighbouring
suffixes. The deepest LCP interval that holds a suffix is the longest substring repeated from there on,
so the union of the spans of all maximal repeats is the union of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Grid, chunks, grid, mix, tidy

SYMBOLS = b"#*$%&|<>"
CONTINUED = (np.arange(256) & 0xC0) == 0x80
SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest sequence from it on that occurs again in its text.

    Prefix doubling: ``rank`` orders suffixes by their first 2**k words and is refined only where it still
    has ties. ``levels`` keeps each order's classes, from which LCPs of neighbours are read off.
    """
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        key = mix(words ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # a word alone in its class is settled
    tied = ~(new & np.concatenate([new[1:], [True]]))
    active = order[tied]
    levels, step = [rank.copy()], 1
    last = np.searchsorted(doc, doc, side="right")  # behind the last word of each word's text
    while len(active):
        ahead = active + step
        follow = np.where(ahead < last[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(rank[active] * (n + 1) + follow, kind="stable")
        active, group, follow = active[by], rank[active][by], follow[by]
        lead = np.concatenate([[True], group[1:] != group[:-1]])
        new = lead | np.concatenate([[True], follow[1:] != follow[:-1]])
        at = np.arange(len(active))
        rank[active] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(lead, at, 0))
        levels.append(rank.copy())
        active = active[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, lcp = a[near], b[near], np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + lcp, b + lcp
        inside = (i < n) & (j < n)
        lcp += np.where(inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)]), 1 << k, 0)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least ``least`` words."""
    at = np.flatnonzero(length >= least)
    edge = np.zeros(len(length) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length[at], -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_lines(g: Grid) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text, counted per text."""
    starts = np.union1d(g.offsets[:-1], np.flatnonzero(g.data == 10) + 1)
    starts = starts[starts < len(g.data)]
    doc = np.searchsorted(g.offsets, starts, side="right") - 1
    behind = np.append(starts[1:], len(g.data))
    ends = np.where(g.data[behind - 1] == 10, behind - 1, behind) if len(starts) else behind
    held = np.searchsorted(g.starts, ends) > np.searchsorted(g.starts, starts)
    doc, line = doc[held], g.hashes(starts[held], ends[held])
    by = np.lexsort((line, doc))
    again = (doc[by][1:] == doc[by][:-1]) & (line[by][1:] == line[by][:-1])
    return np.bincount(doc[by][1:][again], minlength=len(g))


def measure(texts: pa.Array, window: int, least: int) -> dict[str, np.ndarray]:
    g = grid(texts)
    length = repeats(g.words(), g.doc)
    per = lambda flags: np.bincount(g.doc[flags], minlength=len(g))
    inside = np.zeros(len(g.data) + 1, np.int64)
    np.add.at(inside, g.starts, 1)
    np.add.at(inside, g.ends, -1)
    letters = (np.cumsum(inside[:-1]) > 0) & ~CONTINUED[g.data]
    longest = np.zeros(len(g), np.int64)
    np.maximum.at(longest, g.doc, length)
    return dict(zip(FIELDS, (np.diff(g.first), g.per_doc(letters), g.per_doc(SYMBOL[g.data]), repeated_lines(g), per(covered(length, window)), per(covered(length, least)), longest), strict=True))


def quality(
    df: DataFrame,
    text: str = "text",
    *,
    min_words: int = 10,
    window: int = 5,
    max_window_percent: int = 20,
    min_repeat: int = 10,
    max_covered: float = 0.2,
    max_longest: int = 50,
) -> DataFrame:
    """``df`` with its counts, ``base_failed`` and ``kept``.

    ``kept`` asks for a text that passes the base rule, has at most ``max_covered`` of its words in repeats of
    ``min_repeat`` words or more, and repeats no sequence of more than ``max_longest`` words. A null text counts
    as one without words and fails. Rows are judged one by one: repeated rows get equal results, an empty table
    gives an empty one, and input columns named like an output are replaced.
    """
    kept = [c for c in df.columns if c.lower() not in FIELDS or c == text]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), *(f"{c} long" for c in FIELDS)])

    @tidy
    def run(batches):
        for batch in batches:
            column = batch.column(kept.index(text))
            for start, stop in chunks(column):
                counts = measure(column.slice(start, stop - start), window, min_repeat)
                yield pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in batch.columns), *(pa.array(counts[c].astype(np.int64)) for c in FIELDS)], names=[*kept, *FIELDS])

    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_window_percent * F.col("n_words"))
    found = source.mapInArrow(run, schema).withColumn("base_failed", failed)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("covered_words") <= F.lit(max_covered) * F.col("n_words")) & (F.col("longest_repeat") <= max_longest))
