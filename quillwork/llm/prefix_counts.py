"""Token counts by prefix dynamic programming (operator 4).

For a word of base symbols, the last token of the encoding of every prefix is the one token that ends there
and stands next to the last token of what precedes it; the prefix's count is one more than that of what
precedes. One pass so gives the counts of all prefixes, in time linear in the word. Words are independent,
so a text's prefix counts are running sums over its words. Stored once, they answer how many tokens a prefix
has, without encoding again. Where a budget ends is looked up in them and, inside one piece, by the same pass.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .arrowtext import chunks

MEMORY = 400_000
CONTRACTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Counter:
    """Counts tokens on one worker, for a BPE tokenizer file with an end-of-word suffix and a splitting pre-tokenizer that drops white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(a, b): r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.vocab = spec["model"]["vocab"]
        #: For each token, the rank of the merge that makes it and its two parts; -1 for base symbols.
        self.parts = {a + b: (a, b) for a, b in reversed(merges)}
        self.formed = {t: self.ranks[self.parts[t]] if t in self.parts else -1 for t in self.vocab} | {"": -1}
        own = Tokenizer.from_file(path)
        self.normalise = own.normalizer.normalize_str if own.normalizer else str
        self.words_of = own.pre_tokenizer.pre_tokenize_str
        #: On visible ASCII and line feeds, this normaliser lower-cases and the pre-tokenizer finds its one pattern.
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        known = kinds == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert")
        self.ascii_words = regex.compile(split["pattern"]["Regex"]).findall if known else None
        #: For this pattern, a word's prefix of more than three characters is one word too: only 'll and its like are not.
        self.contracting = known and split["pattern"]["Regex"] == CONTRACTING
        self.specials = [t["content"] for t in spec["added_tokens"]]
        #: Tokens that are what their own symbols encode to, without the suffix: inside a word, at its end.
        stands = {t for t in self.vocab if self.merged(self.symbols(t)) == [t]}
        if self.suffix:
            self.ending = {t[: -len(self.suffix)] for t in stands if t.endswith(self.suffix)}
            self.inside = {t for t in stands if not t.endswith(self.suffix)}
        else:
            self.ending = self.inside = stands
        self.longest, self.longest_end = (max(map(len, x), default=1) for x in (self.inside, self.ending))
        self.beside: dict[tuple[str, str], bool] = {}
        self.of_word: dict[str, int] = {}
        self.counts: dict[str, int] = {}

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """BPE of a few symbols, merge by merge."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), k) for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == len(self.ranks):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def joins(self, left: str, right: str) -> bool:
        """Whether the two tokens' symbols encode to just these two tokens.

        Merges are undone from the latest back; at none of these times may the two symbols at the border merge.
        Of equal merges the left one comes first.
        """
        a, b, limit = left, right, len(self.ranks)
        while True:
            if self.ranks.get((a, b), limit) < limit:
                return False
            m, n = self.formed[a], self.formed[b]
            if m > n:
                limit, a = m, self.parts[a][1]
            elif n < 0:
                return True
            else:
                limit, b = n + 1, self.parts[b][0]

    def prefixes(self, word: str, every: bool = True) -> list[int]:
        """Token counts of the word's prefixes of 1, 2, ... symbols, each taken as a word of its own.

        Only one token fits at each end, so candidates are tried from the shortest on.
        Symbols that the vocabulary lacks give no token. With ``every`` false, only the last count is right.
        """
        beside, inside, ending, suffix = self.beside, self.inside, self.ending, self.suffix
        last, count, out = [""], [0], []
        for end in range(1, len(word) + 1):
            if every or end == len(word):
                n = count[end - 1]
                for start in range(end - 1, max(-1, end - self.longest_end - 1), -1):
                    token = word[start:end]
                    if token in ending and (start == 0 or self.joins(last[start], token + suffix)):
                        n = count[start] + 1
                        break
                out.append(n)
            else:
                out.append(0)
            if end < len(word):
                for start in range(end - 1, max(-1, end - self.longest - 1), -1):
                    token = word[start:end]
                    if token in inside:
                        if start == 0:
                            break
                        pair = (last[start], token)
                        joins = beside.get(pair)
                        if joins is None:
                            joins = beside[pair] = self.joins(*pair)
                        if joins:
                            break
                else:
                    start, token = end - 1, ""
                last.append(token)
                count.append(count[start] + (token != ""))
        if len(beside) > MEMORY:
            beside.clear()
        return out

    def _words(self, piece: str) -> list[str]:
        """Normalised pre-tokens; for visible ASCII without a call for each piece into the library."""
        if self.ascii_words and piece.isascii() and piece.replace("\n", "").isprintable():
            return self.ascii_words(piece.lower())
        return [word for word, _ in self.words_of(self.normalise(piece))]

    def _plain(self, piece: str) -> int:
        total, known = 0, self.of_word
        for word in self._words(piece):
            n = known.get(word)
            if n is None:
                if len(known) > 2 * MEMORY:
                    known.clear()
                n = known[word] = 1 if word in self.ending else self.prefixes(word, False)[-1]
            total += n
        return total

    def count(self, piece: str) -> int:
        """Tokens of a piece of text; special strings inside count one each, as the library takes them."""
        found = self.counts.get(piece)
        if found is None:
            if len(self.counts) > MEMORY:
                self.counts.clear()
            at = [(piece.find(s), -len(s)) for s in self.specials if s in piece]
            if at:
                start, size = min(at)
                found = (self._plain(piece[:start]) if start else 0) + 1 + (self.count(piece[start - size :]) if start - size < len(piece) else 0)
            else:
                found = self._plain(piece)
            self.counts[piece] = found
        return found

    def table(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the text's pieces end, in characters, and how many tokens it has up to each such end."""
        pieces = text.split(" ")
        known = self.counts
        counts = [known[p] if p in known else self.count(p) for p in pieces]
        return np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1, np.cumsum(np.array(counts, np.int64))

    def at(self, text: str, length: int) -> int:
        """Tokens of the first ``length`` characters, by table and one piece."""
        ends, counts = self.table(text)
        k = int(np.searchsorted(ends, length, side="right"))
        start = int(ends[k - 1]) + 1 if k else 0
        return (int(counts[k - 1]) if k else 0) + (self.count(text[start:length]) if length > start else 0)

    def within(self, text: str, budget: int, table: tuple[np.ndarray, np.ndarray] | None = None) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens; ``table`` is the text's own, if at hand.

        Counts at the ends of pieces only grow, so it ends before the end of the first piece that is too much. There,
        and in its runs without white space, the same holds.
        """
        ends, counts = self.table(text) if table is None else table
        k = int(np.searchsorted(counts, budget, side="right"))
        if k == len(ends):
            return len(text)
        start, left = (int(ends[k - 1]) + 1, budget - int(counts[k - 1])) if k else (0, budget)
        if left < 0:
            return 0
        for run in regex.finditer(r"[^\n\r\t]+|[\n\r\t]+", text[start : int(ends[k])]):
            n = self.count(run[0])
            if n > left:
                return start + run.start() + self._run_within(run[0], left)
            left -= n
        return int(ends[k])

    def _run_within(self, run: str, budget: int) -> int:
        """``within`` for text without spaces that has more than ``budget`` tokens."""
        at = 0
        plain = self.contracting and not any(s in run for s in self.specials)
        if plain:  # a letter after a sign starts a word
            parts = regex.split(r"(?V1)(?<=[^\s\p{L}\p{N}\p{M}'])(?=\p{L})", run)
            for part in parts:
                n = self._plain(part)
                if n > budget:
                    run = part
                    break
                budget -= n
                at += len(part)
        if plain and not regex.search(r"[\s\x1c-\x1f]", run) and "".join(map(self.normalise, run)) == (normal := self.normalise(run)) and len(normal) == len(run):
            for word in self.ascii_words(normal):
                n = self._plain(word)
                if n > budget:
                    whole = self.words_of(word)[0][0] if len(word) > 3 else ""
                    counts = self.prefixes(whole) if whole else []
                    size = np.cumsum([len(c.encode()) for c in word])
                    for k in range(len(word) - 1, 0, -1):
                        if (counts[size[k - 1] - 1] if k > 3 else self._plain(word[:k])) <= budget:
                            return at + k
                    return at
                budget -= n
                at += len(word)
        # texts that change their length or neighbours when normalised: every prefix on its own
        return at + next(k for k in range(len(run) - 1, -1, -1) if (self._fresh(run[:k]) if k else 0) <= budget)

    def _fresh(self, piece: str) -> int:
        """``count`` of a piece that will not come again."""
        at = [(piece.find(s), -len(s)) for s in self.specials if s in piece]
        if not at:
            return self._plain(piece)
        start, size = min(at)
        return self._plain(piece[:start]) + 1 + self._fresh(piece[start - size :])


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def prefix_counts(df: DataFrame, path: str, text: str = "text", *, ends: str = "prefix_ends", counts: str = "prefix_tokens", budget: int | None = None, within: str = "prefix_within") -> DataFrame:
    """``df`` with the arrays ``ends`` (positions before each space and at the end, in characters) and ``counts``
    (tokens of the text up to there). ``path`` names the tokenizer file, on every executor. With a ``budget`` there is
    also ``within``: characters of the longest prefix, at any character, of at most so many tokens.

    A null text counts as empty: one end at 0, no tokens. Texts are taken whole and row by row; input columns
    named like an output are replaced.
    """
    new = {ends.lower(), counts.lower()} | ({within.lower()} if budget is not None else set())
    kept = [c for c in df.columns if c == text or c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), f"`{ends}` array<int>", f"`{counts}` array<int>", *([f"`{within}` long"] if budget is not None else [])])

    def run(batches):
        own = counter(path)
        for batch in batches:
            column = batch.column(kept.index(text))
            for start, stop in chunks(column):
                texts = pc.fill_null(column.slice(start, stop - start), "").to_pylist()
                tables = [own.table(t) for t in texts]
                at = pa.array(np.cumsum([0, *(len(e) for e, _ in tables)]), pa.int32())
                made = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([t[k] for t in tables]), pa.int32())) for k in (0, 1)]
                names = [*kept, ends, counts]
                if budget is not None:
                    made.append(pa.array([own.within(t, budget, x) for t, x in zip(texts, tables, strict=True)], pa.int64()))
                    names.append(within)
                yield pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in batch.columns), *made], names=names)

    return source.mapInArrow(run, schema)


def total_tokens(counts: str = "prefix_tokens") -> Column:
    return F.element_at(F.col(counts), -1).cast("long")


def prefix_within(budget: int, ends: str = "prefix_ends", counts: str = "prefix_tokens") -> Column:
    """Characters of the longest stored prefix of at most ``budget`` tokens; ``prefix_counts`` with a budget gives the longest of all."""
    held = F.size(F.filter(F.col(counts), lambda c: c <= budget))
    return F.when(held > 0, F.element_at(F.col(ends), F.greatest(held, F.lit(1)))).otherwise(0).cast("long")
