"""A sparse index that grows by increments: immutable segments, tombstones and sums.

An increment writes one segment of its own documents' postings, the changes it makes to document frequencies, and
tombstones of the versions it replaces. A forward table in buckets of the document's id says what those versions held.
Many small segments are merged into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bm25_tokens
from ..sources.tables import Draft, Versions
from .bm25 import BLOCK_DOCS, EPSILON, PARTS, Index, blocks_of, part_of


def _raw_idf(n_docs: int, df: Column) -> Column:
    return F.log(F.lit(n_docs) - df + 0.5) - F.log(df + 0.5)


class Segments:
    """An index under ``root``, of documents whose id has the type ``kind``."""

    def __init__(self, spark: SparkSession, root: str, *, kind: str = "long", parts: int = PARTS, block_docs: int = BLOCK_DOCS, bucket_rows: int = 100_000):
        self.store, self.kind, self.parts, self.block_docs, self.bucket_rows = Versions(spark, root), kind, parts, block_docs, bucket_rows

    def _open(self, draft: Draft) -> dict:
        """The notes of the forward table, which is made with the first increment: n_docs, total length, the segments with their
        sizes, and where merged ones have gone."""
        if "docs" not in draft.held:
            draft.create("docs", f"doc_id {self.kind}, length int, terms array<string>, segment int", ["doc_id"], self.bucket_rows)
            draft.notes("docs").update(n_docs=0, total=0, next=0, segments={}, merged={})
        return draft.notes("docs")

    def _now(self, notes: dict, segment: Column) -> Column:
        """The segment that holds what was written as ``segment``."""
        for old, new in notes["merged"].items():
            segment = F.when(segment == int(old), new).otherwise(segment)
        return segment

    def add(self, docs: DataFrame, removed: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> int:
        """A version with ``docs`` in place of what they were, and without the documents of ``removed`` (a column named as
        ``doc_id``). Ids are not null and come once, or the version is refused; an id in both is removed. The index is read in the buckets of these ids and
        the folders of these terms only."""
        spark = self.store.spark
        ids = (docs.select(F.col(doc_id).cast(self.kind).alias("doc_id")).limit(0) if removed is None else removed.select(F.col(doc_id).cast(self.kind).alias("doc_id"))).where("doc_id is not null").distinct()
        with self.store.begin() as draft:
            notes = self._open(draft)
            segment = notes["next"]
            own = docs.select(F.col(doc_id).cast(self.kind).alias("doc_id"), F.col(text).alias("text")).join(ids, "doc_id", "left_anti")
            tokens = own.withColumn("tokens", bm25_tokens(F.col("text")))
            rows = draft.put("increment", tokens.select("doc_id", F.size("tokens").alias("length"), F.array_distinct("tokens").alias("terms"), F.lit(segment).alias("segment"), "text"))
            draft.check(repeated=rows.groupBy("doc_id").count().where("count > 1 or doc_id is null"))
            forward = rows.drop("text")
            touched = forward.unionByName(ids, allowMissingColumns=True)
            before = draft.read("docs")
            old = {}

            def change(held: DataFrame, batch: DataFrame) -> DataFrame:
                old["rows"] = held.join(batch.select("doc_id"), "doc_id", "left_semi")
                return held.join(batch.select("doc_id"), "doc_id", "left_anti").select(*before.columns).unionByName(batch.where("length is not null"))

            draft.merge("docs", touched, change)
            gone = draft.put("gone", old["rows"].withColumn("segment", self._now(notes, F.col("segment"))) if "rows" in old else before.limit(0))
            deltas = forward.select(F.explode("terms").alias("term"), F.lit(1).alias("n")).unionAll(gone.select(F.explode("terms"), F.lit(-1)))
            changed = deltas.groupBy("term").agg(F.sum("n").alias("df")).where("df <> 0").withColumn("part", part_of("term", self.parts))
            terms = draft.put(f"terms-{segment}", changed.select("part", "term", "df"), by=("part", "term"))
            self._count(draft, notes, terms)
            draft.put(f"blocks-{segment}", blocks_of(self._postings(rows), max(1, rows.count()), self.block_docs, self.parts), by=("part", "term", "block"))
            sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
            less = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
            dead = gone.select("segment", "doc_id")
            draft.put("tombstones", draft.read("tombstones").unionByName(dead) if "tombstones" in draft.held else dead)
            notes = draft.notes("docs")
            notes.update(n_docs=notes["n_docs"] + sizes.n - less.n, total=notes["total"] + sizes.total - less.total, next=segment + 1, segments={**notes["segments"], str(segment): sizes.n})
            for name in ("increment", "gone"):
                draft.forget(name)
            return draft.publish(keep=2)

    def _postings(self, rows: DataFrame) -> DataFrame:
        words = rows.select("doc_id", "length", F.explode(bm25_tokens(F.col("text"))).alias("term"))
        return words.groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))

    def _sums(self, draft_or_held: Callable[[str], DataFrame], segments: list[str], parts: list[int] | None = None) -> DataFrame:
        """part, term and df over segments."""
        found = None
        for s in segments:
            one = draft_or_held(f"terms-{s}")
            one = one if parts is None else one.where(F.col("part").isin(parts))
            found = one if found is None else found.unionByName(one)
        return found.groupBy("part", "term").agg(F.sum("df").alias("df"))

    def _count(self, draft: Draft, notes: dict, terms: DataFrame) -> None:
        """How many terms have which document frequency, which the least idf depends on: a small table, changed by the terms of an
        increment."""
        new = terms.select("term", F.col("df").alias("d"))
        if notes["segments"]:
            parts = [r.part for r in terms.select("part").distinct().collect()]  # folders
            held = self._sums(draft.read, list(notes["segments"]), parts)
            both = terms.select("part", "term", F.col("df").alias("d")).join(held, ["part", "term"], "left").select("d", F.coalesce("df", F.lit(0)).alias("was"))
        else:
            both = new.select("d", F.lit(0).cast("long").alias("was"))
        moved = both.select(F.col("was").alias("df"), F.lit(-1).alias("n")).unionAll(both.select(F.col("was") + F.col("d"), F.lit(1)))
        moved = moved.unionByName(draft.read("frequencies")) if "frequencies" in draft.held else moved
        draft.put("frequencies", moved.where("df > 0").groupBy("df").agg(F.sum("n").alias("n")).where("n <> 0"))

    def read(self) -> Index | None:
        """The index as it is: what ``bm25.search`` takes, and None where there is no whole version."""
        held = self.store.latest()
        if not held or "docs" not in held:
            return None
        notes, get = held["docs"]["notes"], lambda name: self.store.rows(held[name])
        n_docs, segments = notes["n_docs"], sorted(map(int, notes["segments"]))
        if not segments:
            return None
        mean = get("frequencies").agg((F.sum(_raw_idf(n_docs, F.col("df")) * F.col("n")) / F.sum("n")).alias("mean")).first().mean
        raw = _raw_idf(n_docs, F.col("df"))
        terms = self._sums(get, [str(s) for s in segments]).where("df > 0").select("part", "term", "df", F.when(raw < 0, F.lit((mean or 0.0) * EPSILON)).otherwise(raw).alias("idf"))
        blocks = None
        for s in segments:
            one = get(f"blocks-{s}").withColumn("block", F.lit(s << 32) + F.col("block"))
            blocks = one if blocks is None else blocks.unionByName(one)
        dead = get("tombstones").select((F.col("segment").cast("long")).alias("segment"), "doc_id")
        entries = blocks.select("term", "block", F.explode("entries").alias("e")).select("term", F.shiftright("block", 32).alias("segment"), "e.*")
        postings = entries.join(dead, ["segment", "doc_id"], "left_anti").select("doc_id", "length", "term", "tf")
        corpus = self.store.spark.createDataFrame([(n_docs, notes["total"] / n_docs if n_docs else None)], "n_docs long, avg_length double")
        return Index(postings, terms, corpus, blocks, dead, self.parts)

    def merge(self, most: int = 8) -> bool:
        """With more than ``most`` segments, merges the smallest half of them into one, without what is dead; whether it did."""
        with self.store.begin() as draft:
            if "docs" not in draft.held or len(draft.notes("docs")["segments"]) <= most:
                return False
            notes = draft.notes("docs")
            small = sorted(notes["segments"], key=lambda s: (notes["segments"][s], int(s)))[: len(notes["segments"]) // 2 + 1]
            segment, dead = notes["next"], draft.read("tombstones")
            postings = None
            for s in small:
                one = draft.read(f"blocks-{s}").select("term", F.explode("entries").alias("e")).select("term", "e.*")
                one = one.join(dead.where(F.col("segment") == int(s)).select("doc_id"), "doc_id", "left_anti")
                postings = one if postings is None else postings.unionByName(one)
            n = sum(notes["segments"][s] for s in small) - dead.where(F.col("segment").isin([int(s) for s in small])).count()
            draft.put(f"blocks-{segment}", blocks_of(postings, max(1, n), self.block_docs, self.parts), by=("part", "term", "block"))
            draft.put(f"terms-{segment}", self._sums(draft.read, small).where("df <> 0"), by=("part", "term"))
            draft.put("tombstones", dead.where(~F.col("segment").isin([int(s) for s in small])))
            for s in small:
                draft.forget(f"blocks-{s}")
                draft.forget(f"terms-{s}")
            merged = {old: segment if str(new) in small else new for old, new in notes["merged"].items()} | {s: segment for s in small}
            notes.update(next=segment + 1, segments={s: k for s, k in notes["segments"].items() if s not in small} | {str(segment): n}, merged=merged)
            draft.publish(keep=2)
        return True
