"""Periodic runs of words, by a suffix automaton with link-cut access (operator 11).

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Appending word r to a
text recolours the path from the automaton's state of that prefix to its root: the colour of a node is where its
strings ended last. The path falls into segments of one colour e; the longest string of a segment, of length l, ended
last at e, so with distance d = r - e <= l the text has a square of period d that ends at r and reaches l + d words
back. Squares of one period and start are one run, as far as they go.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import Grid, chunks, grid, mix, shingles, tidy

RUNS = "array<struct<start:long,length:long,period:long>>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Rounds of narrowing down where runs can be; any number gives the same runs.
ROUNDS = 8


def automaton(words: Sequence[int]) -> tuple[array, array, array]:
    """Of the suffix automaton: each state's longest length and suffix link, and the state of every prefix.

    State 1 is the root, 0 none. Most states have one transition, kept in two arrays; the others' are in dictionaries.
    """
    size = 2 * len(words) + 2
    length, link, word, to = (array("i", bytes(4 * size)) for _ in range(4))
    more: dict[int, dict[int, int]] = {}
    prefix = array("i", bytes(4 * (len(words) + 1)))
    prefix[0] = last = count = 1
    for r, w in enumerate(words, 1):
        count += 1
        new = prefix[r] = count
        length[new] = r
        p, q = last, 0
        while p:
            if not to[p]:
                word[p], to[p] = w, new
            elif word[p] == w:
                q = to[p]
                break
            elif p in more:
                if w in more[p]:
                    q = more[p][w]
                    break
                more[p][w] = new
            else:
                more[p] = {w: new}
            p = link[p]
        last = new
        if not q:
            link[new] = 1
        elif length[q] == length[p] + 1:
            link[new] = q
        else:
            count += 1
            twin = count
            length[twin], link[twin], word[twin], to[twin] = length[p] + 1, link[q], word[q], to[q]
            if q in more:
                more[twin] = dict(more[q])
            link[q] = link[new] = twin
            while p:
                if word[p] == w:
                    if to[p] != q:
                        break
                    to[p] = twin
                elif p in more and more[p].get(w) == q:
                    more[p][w] = twin
                else:
                    break
                p = link[p]
    return length, link, prefix


def squares(words: Sequence[int]) -> dict[tuple[int, int], int]:
    """(start, period) to end of every run of exponent 2 or more.

    The tree of suffix links is kept as paths of one colour, each a splay tree by depth whose root holds the colour;
    ``up`` leads to the parent in it and, from its root, to the node that the path hangs on.
    """
    length, up, prefix = automaton(words)
    left, right, colour = (array("i", bytes(4 * len(up))) for _ in range(3))
    found: dict[tuple[int, int], int] = {}

    def splay(x: int) -> None:
        while True:
            y = up[x]
            if left[y] == x:
                on_left = True
            elif right[y] == x and y:
                on_left = False
            else:
                return
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                straight = (left[z] == y) == on_left
                turns = ((y, z), (x, y)) if straight else ((x, y), (x, z))
            else:
                turns = ((x, y),)
            for a, b in turns:  # a goes above its parent b
                c = up[b]
                if left[b] == a:
                    s = left[b] = right[a]
                    right[a] = b
                else:
                    s = right[b] = left[a]
                    left[a] = b
                if s:
                    up[s] = b
                up[b], up[a] = a, c
                if left[c] == b and c:
                    left[c] = a
                elif right[c] == b and c:
                    right[c] = a
                else:
                    colour[a] = colour[b]

    for r in range(1, len(words) + 1):
        v, below = prefix[r], 0
        while v:
            splay(v)
            last = colour[v]
            if last and length[v] >= r - last:
                found[last - length[v], r - last] = r
            if deeper := right[v]:
                colour[deeper] = last
            right[v] = below
            below, v = v, up[v]
        colour[below] = r
    return found


def gram(least: int, exponent: int) -> int:
    """How long windows can be so that each window of a run occurs again in that run, one period away."""
    width = min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 2))
    if exponent < 2 or width < 1:
        raise ValueError("runs must have an exponent of 2 or more, and enough words for it")
    return width


def stretches(words: np.ndarray, doc: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Ranges of words, apart from each other, that hold all runs: in them each window has an equal one no farther away than a
    period can be. Equal words have equal numbers in ``words``; no two texts share a range."""
    width = gram(least, exponent)
    key, at = shingles(words, doc, width)
    part = doc[at].astype(np.int64)
    for _ in range(ROUNDS):
        if not len(at):
            return []
        with np.errstate(over="ignore"):
            by = np.argsort(key ^ mix(part.astype(np.uint64)), kind="stable")
        same = (key[by][1:] == key[by][:-1]) & (part[by][1:] == part[by][:-1])
        gap = np.where(same, at[by][1:] - at[by][:-1], np.iinfo(np.int64).max)
        near = np.empty(len(at), np.int64)
        near[by] = np.minimum(np.append(gap, np.iinfo(np.int64).max), np.insert(gap, 0, np.iinfo(np.int64).max))
        room = np.bincount(part)[part] + width - 1
        kept = near <= room // exponent
        key, at, owner = key[kept], at[kept], part[kept]
        part = np.cumsum(np.concatenate([[0], (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])])) if len(at) else owner
        enough = (np.bincount(part) + width - 1 >= least)[part] if len(at) else kept[:0]
        if kept.all() and enough.all():
            break
        key, at, part = key[enough], at[enough], part[enough]
        part = np.unique(part, return_inverse=True)[1]
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(at) else np.zeros(1, int)
    return [(int(at[a]), int(at[b - 1]) + width) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def runs_in(g: Grid, raw: bytes, least: int, exponent: int) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text that has any, by start, then period."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in stretches(g.words(), g.doc, least, exponent):
        ids: dict[bytes, int] = {}
        words = [ids.setdefault(raw[s:e], len(ids)) for s, e in zip(g.starts[a:b].tolist(), g.ends[a:b].tolist(), strict=True)]
        d = int(g.doc[a])
        offset = a - int(g.first[d])
        found = [(s + offset, e - s, q) for (s, q), e in squares(words).items() if e - s >= max(least, exponent * q)]
        if found:
            out.setdefault(d, []).extend(found)
    return {d: sorted(r, key=lambda x: (x[0], x[2])) for d, r in out.items()}


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join(w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d)


def find_runs(df: DataFrame, text: str = "text", *, least: int = 6, exponent: int = 4) -> DataFrame:
    """``df`` with ``runs`` (start, length and period in words, by start, then period) and ``collapsed``: the words of the text
    joined by one space, without those that a run holds behind its first period.

    Runs have ``least`` words and ``exponent`` periods or more. A word is what stands between spaces, tabs and line ends;
    words are equal if their bytes are. Null and empty texts have no runs and an empty ``collapsed``. Texts are taken
    whole and one by one: repeated rows get equal results, an empty table gives an empty one, other columns stay, and
    input columns named like an output are replaced. A task holds some 60 bytes for each byte of its longest text,
    and 150 more for each word where that text may be periodic.
    """
    gram(least, exponent)
    kept = [c for c in df.columns if c.lower() not in ("runs", "collapsed") or c == text]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    if any(c.lower() in ("runs", "collapsed") for c in kept):
        raise ValueError("the text column cannot be named like an output")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), f"runs {RUNS}", "collapsed string"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(kept.index(text))
            for first, stop in chunks(column):
                part = batch.slice(first, stop - first)
                g = grid(part.column(kept.index(text)))
                raw = g.data.tobytes()
                found = runs_in(g, raw, least, exponent)
                texts = []
                for d in range(len(g)):
                    words = raw[g.offsets[d] : g.offsets[d + 1]].split()
                    texts.append(collapse(words, found[d]) if d in found else b" ".join(words))
                listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(d, ())] for d in range(len(g))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(listed, _ARROW), pa.array(texts, pa.binary()).cast(pa.string())], names=[*kept, "runs", "collapsed"])

    return source.mapInArrow(run, schema)
