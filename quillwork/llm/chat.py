"""Chat formatting of typed content parts (operator 3).

A turn holds an ordered list of parts. A visitor flattens it: text parts are escaped, image, audio and document
parts become numbered placeholders with a reference to the attachment and the number of tokens it expands to.
Turns are then framed by control strings. Inside texts the character that opens a control string is doubled with
a mark, so a control string cannot occur there and reading back gives the texts as they were.

    <s>[role]text</s>      with every "<" of role and text written "<."  and every "]" of the role "<|"
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SHUT, ROLE_OPEN, ROLE_SHUT = "<s>", "</s>", "[", "]"
#: What one attachment expands to, from its own size; all are parameters of ``flatten``.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 1024
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN = re.compile(r"<s>\[([^\]]*)\]((?:[^<]++|<\.|<@[a-z]+:\d+>)*+)</s>")
MARK = re.compile(r"<@([a-z]+):(\d+)>")


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("<."))


def unescape(text: str) -> str:
    return text.replace("<.", "<")


class Visitor:
    """One method for each kind of part; what it returns is text of the turn."""

    def __init__(self, patch: int, rate: float, page_tokens: int):
        self.patch, self.rate, self.page_tokens = patch, rate, page_tokens
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part['kind']}", self.visit_other)(part)

    def visit_text(self, part: dict) -> str:
        return (part["text"] or "").replace("<", "<.")

    def visit_image(self, part: dict) -> str:
        side = lambda n: max(1, math.ceil((n or 0) / self.patch))
        return self._attach(part, side(part["width"]) * side(part["height"]))

    def visit_audio(self, part: dict) -> str:
        return self._attach(part, max(1, math.ceil((part["seconds"] or 0) * self.rate)))

    def visit_document(self, part: dict) -> str:
        return self._attach(part, max(1, part["pages"] or 0) * self.page_tokens)

    def visit_other(self, part: dict) -> str:
        raise ValueError(f"unknown kind of part: {part['kind']!r}")

    def _attach(self, part: dict, tokens: int) -> str:
        self.attachments.append({"kind": part["kind"], "ref": part["ref"], "tokens": tokens})
        return f"<@{part['kind']}:{len(self.attachments) - 1}>"


def flatten(df: DataFrame, parts: str = "parts", *, patch: int = PATCH, audio_rate: float = AUDIO_RATE, page_tokens: int = PAGE_TOKENS) -> DataFrame:
    """``df`` with ``flat`` (the turn's escaped text with placeholders ``<@kind:number>``), ``attachments`` (kind,
    ref and expanded tokens, in order) and ``attachment_tokens`` instead of ``parts`` (an array of ``PART``).

    No parts and null parts give an empty turn. A kind without a visitor's method is an error.
    """
    new = {"flat", "attachments", "attachment_tokens"}
    kept = [c for c in df.columns if c != parts and c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{parts}`").cast(f"array<{PART}>").alias("_parts"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "flat string", "attachments array<struct<kind:string,ref:string,tokens:long>>", "attachment_tokens long"])
    kinds = [pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])), pa.int64()]

    def run(batches):
        for batch in batches:
            flat, held = [], []
            for row in batch.column(len(kept)).to_pylist():
                visitor = Visitor(patch, audio_rate, page_tokens)
                flat.append("".join(visitor.visit(p) for p in row or () if p))
                held.append(visitor.attachments)
            made = [flat, held, [sum(a["tokens"] for a in x) for x in held]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names=[*kept, "flat", "attachments", "attachment_tokens"])

    return source.mapInArrow(run, schema)


def text_part(text: str = "text") -> Column:
    """A list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.col(f"`{text}`").alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """One row per conversation from flattened turns: ``conv_id``, ``formatted``, ``n_turns``, ``attachments``
    (in the order of the turns, with the turn's number) and ``attachment_tokens``.

    Turns go by number, then role, then text, nulls first; a null role is an empty one; turns with a null
    conv_id make up a conversation of their own. Turns repeated in the table are repeated in the output.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce("flat", F.lit("")).alias("flat"), "attachments", "attachment_tokens").alias("t"),
    )

    def line(t: Column) -> Column:
        return F.concat(F.lit(OPEN + ROLE_OPEN), F.replace(escape(t["role"]), F.lit("]"), F.lit("<|")), F.lit(ROLE_SHUT), t["flat"], F.lit(SHUT))

    def placed(t: Column) -> Column:
        return F.transform(t["attachments"], lambda a: F.struct(t["turn"].alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))

    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "conv_id",
        F.array_join(F.transform("ts", line), "").alias("formatted"),
        F.size("ts").cast("long").alias("n_turns"),
        F.flatten(F.transform("ts", placed)).alias("attachments"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda total, t: total + t["attachment_tokens"]).alias("attachment_tokens"),
    )


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Role and flattened, unescaped text of every turn; an error if the string is not a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError("not a formatted conversation")
        out.append((unescape(found[1].replace("<|", "]")), unescape(found[2])))
        at = found.end()
    return out


def read_back(chats: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256`` and ``formatted_chars``, all read
    from ``formatted``. The loss mask covers the texts of ``loss_role``."""
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        for batch in batches:
            rows = []
            for formatted in batch.column(1).to_pylist():
                turns = turns_of(formatted)
                loss = "".join(text for role, text in turns if role == loss_role)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            made = [pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["conv_id", *names])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.select("conv_id", "formatted").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
