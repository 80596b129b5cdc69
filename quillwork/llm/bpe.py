"""Byte-level BPE through a sentencepiece model made straight from a vocabulary (operator 10).

Every vocabulary entry becomes a piece: its bytes mapped to one visible character each, scored by negative
rank, so that sentencepiece's best-pair-first merging makes the same merges as rank-ordered BPE. The model
normalises nothing. Pre-tokens are mapped, encoded one by one and mapped back on decoding.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, tidy

#: Entries that a worker remembers; beyond it starts afresh, so memory is bounded and results stay the same.
MEMORY = 50_000


def byte_characters() -> list[str]:
    """A visible character for each byte: itself where it is visible, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes, varint or 32-bit float."""

    def varint(n: int) -> bytes:
        n &= (1 << 64) - 1
        out = b""
        while n > 0x7F:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; one more piece stands for unknowns."""
    table = dict(enumerate(byte_characters()))
    pieces = [None] * len(ranks)
    for token, rank in ranks.items():
        pieces[rank] = token.decode("latin-1").translate(table)
    if None in pieces:
        raise ValueError("ranks must run from 0 without gaps")
    out = [_field(1, _field(1, p.encode()) + _field(2, -float(r)) + _field(3, 1)) for r, p in enumerate(pieces)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(out)) + _field(40, len(pieces)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, plain)


class Codec:
    """Encodes and decodes on one worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.pattern = regex.compile(pattern)
        self.table = dict(enumerate(byte_characters()))
        back = {c: bytes([b]) for b, c in self.table.items()}
        self.bytes_of = [b"".join(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.ranks))]
        #: A space with another white space or nothing behind it: only there may a pre-token reach over a space.
        self.loose = regex.compile(r" (?:\s|\Z)")
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drops what was learnt, so that a worker between tasks is small."""
        self.pieces.clear()
        self.words.clear()

    def _cut(self, text: str) -> list[str]:
        """Cut before single spaces, where the pattern always starts a new match."""
        if self.loose.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def _learn(self, pieces: set[str]) -> None:
        split = {p: self.pattern.findall(p) for p in pieces}
        new = {w for words in split.values() for w in words} - self.words.keys()
        if len(self.words) + len(new) > MEMORY:
            self.words.clear()
            new = {w for words in split.values() for w in words}
        rest = []
        for w in new:
            rank = self.ranks.get(w.encode())
            if rank is None:
                rest.append(w)
            else:
                self.words[w] = struct.pack("<I", rank)
        mapped = [w.encode().decode("latin-1").translate(self.table) for w in rest]
        for w, ids in zip(rest, self.model.encode(mapped, num_threads=1), strict=True):
            self.words[w] = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.pieces) + len(pieces) > MEMORY:
            self.pieces.clear()
        for p, words in split.items():
            self.pieces[p] = b"".join([self.words[w] for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        wanted = set().union(*cut)
        new = wanted - self.pieces.keys()
        if new:
            if len(self.pieces) + len(new) > MEMORY:
                self.pieces.clear()
                new = wanted
            self._learn(new)
        found = self.pieces
        return [b"".join([found[p] for p in pieces]) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", *, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with binary column ``ids``: the tokens of ``text`` as little-endian unsigned 32-bit integers.

    ``path`` names a vocabulary file of lines "base64 rank", on every executor. ``decoded``: also decode the ids
    into a binary column of that name. A null or empty text has no ids. Rows are encoded one by one, whole;
    input columns named like an output are replaced.
    """
    new = [ids, *([decoded] if decoded else [])]
    kept = [c for c in df.columns if c == text or c.lower() not in {x.lower() for x in new}]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), *(f"`{c}` binary" for c in new)])

    @tidy
    def run(batches):
        own = codec(path, pattern)
        try:
            for batch in batches:
                column = batch.column(kept.index(text))
                for start, stop in chunks(column):
                    coded = own.encode(pc.fill_null(column.slice(start, stop - start), "").to_pylist())
                    out = [pa.array(coded, pa.binary())]
                    if decoded:
                        out.append(pa.array([own.decode(x) for x in coded], pa.binary()))
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, stop - start) for c in batch.columns), *out], names=[*kept, *new])
        finally:
            own.forget()

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", *, decoded: str = "decoded") -> DataFrame:
    """``df`` with binary column ``decoded``: the bytes of the tokens in binary column ``ids``; null stays null."""
    kept = [c for c in df.columns if c == ids or c.lower() != decoded.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), f"`{decoded}` binary"])

    @tidy
    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            out = [None if x is None else own.decode(x) for x in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*kept, decoded])

    return source.mapInArrow(run, schema)
