"""The best rows of each query, kept in a task: what goes on from it does not grow with the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: So many scores are taken at once.
CELLS = 1 << 20
#: Half a unit of the ninth digit, which scores are ordered by, and some more.
SLACK = 1e-9


def values(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    return np.array([*column.to_pylist(), None], object)[:-1]


class Best:
    """The ``top_k`` best so far of each query: by score to nine digits, then by document. ``n``: the queries' numbers.

    Scores are compared with what each query's last one has; what reaches that waits until there is much of it.
    """

    def __init__(self, n: np.ndarray, top_k: int):
        self.n, self.top_k = n, top_k
        self.least = np.full(len(n), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.most = 0, max(2 * len(n) * top_k, CELLS)

    def offer(self, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of ``own`` queries (rows) for documents (columns); minus infinity is no score."""
        scores[np.isnan(scores)] = np.inf  # sorts first, as in SQL
        if scores.shape[1] > self.top_k and self.least[own[0]] == -np.inf:
            self.least[own] = np.maximum(self.least[own], np.partition(scores, -self.top_k, axis=1)[:, -self.top_k] - SLACK)
        k, row = np.nonzero((scores >= self.least[own][:, None]) & (scores > -np.inf))
        self.held.append((own[k], ids[row], scores[k, row]))
        self.waiting += len(k)
        if self.waiting > self.most:
            self._cut()

    def _cut(self) -> None:
        k, ids, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        key = np.round(score, 9)
        if ids.dtype == object:
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])), np.int64)
            order = order[np.lexsort((-key[order], k[order]))]
        else:
            order = np.lexsort((ids, -key, k))
        place = np.arange(len(k)) - np.searchsorted(k[order], k[order])
        last, order = order[place == self.top_k - 1], order[place < self.top_k]
        self.least[k[last]] = key[last] - SLACK
        self.held, self.waiting = [(k[order], ids[order], score[order])], 0

    def result(self, kind: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        """n, doc_id (of type ``kind``) and score."""
        if self.held:
            self._cut()
            k, ids, score = self.held[0]
            n, score = self.n[k].astype(np.int32), np.where(score == np.inf, np.nan, score)
            for at in range(0, len(n), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(n[part]), pa.array(ids[part].tolist(), kind), pa.array(score[part])], names=["n", "doc_id", "score"])
