"""The concept graph: nodes, weighted edges, storage and one-hop traversal."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import casefold, concept_form, concept_name, json_object
from ..sources.tables import Versions, files_go, kept
from .stats import cooccurrence

# What a concept can be.
TYPES = ("method", "model", "dataset", "task", "other")
PER_PAPER, NEIGHBOURS, MIN_OVERLAP = 8, 3, 2
#: Names go to the tasks in blocks of at most about so many bytes.
NAME_BYTES = 2 << 20
#: What is looked up for queries goes to the tasks in blocks of at most about so many bytes.
LOOKED_BYTES = 8 << 20


def nodes(rows: DataFrame) -> DataFrame:
    """key (case-folded name), name, concept_type and n_papers from (paper_id, concept_id, name, concept_type); the lowest id
    names the node. The papers of a node, any number of them, are the rows of ``links``."""
    first = F.min(F.struct("concept_id", "name", F.coalesce("concept_type", F.lit("other")).alias("concept_type")))
    named = rows.withColumn("key", casefold(F.col("name"))).groupBy("key").agg(first.alias("f"))
    return named.join(links(rows).groupBy("key").agg(F.count("*").alias("n_papers")), "key").select("key", "f.name", "f.concept_type", "n_papers")


def links(rows: DataFrame) -> DataFrame:
    """key, name (the least spelling) and paper_id, each pair of key and paper once."""
    own = rows.select("paper_id", "name").repartition("paper_id")  # then what is grouped by papers needs no other shuffle
    return own.groupBy(casefold(F.col("name")).alias("key"), "paper_id").agg(F.min("name").alias("name")).select("key", "name", "paper_id")


def edges(rows: DataFrame) -> DataFrame:
    """src < dst and how many papers have both."""
    return _edges(rows.select("paper_id", casefold(F.col("name")).alias("key")))


def _edges(keyed: DataFrame) -> DataFrame:
    keyed = keyed.repartition("paper_id")  # the only shuffle of rows
    return cooccurrence(keyed, None, "paper_id", "key").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("together").alias("weight"))


@dataclass
class Graph:
    """links (key, name, paper_id) and edges (src, dst, weight)."""

    links: DataFrame
    edges: DataFrame

    def write(self, root: str) -> int:
        """A new version under ``root``; readers see it once both tables are whole."""
        return Versions(self.links.sparkSession, root).write(links=self.links, edges=self.edges)

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> Graph | None:
        """The latest version, or None where there is none: the graph leg is then left out."""
        held = Versions(spark, root).read()
        return cls(held["links"], held["edges"]) if held else None


def graph(rows: DataFrame) -> Graph:
    """The graph of (paper_id, concept_id, name, concept_type) rows."""
    return Graph(links(rows), edges(rows))


def store(rows: DataFrame, root: str) -> Graph:
    """The graph of rows, stored as a new version under ``root``; edges are counted from the stored links."""
    with files_go(rows.sparkSession):
        Versions(rows.sparkSession, root).write(links=links(rows), edges=lambda held: _edges(held["links"].select("paper_id", "key")))
    return Graph.read(rows.sparkSession, root)


def mentioned(links_: DataFrame, queries: DataFrame, block_bytes: int = NAME_BYTES) -> DataFrame:
    """qid and key of the concepts whose names the texts of a query (qid, text) mention, on word borders.

    Names go to the tasks in blocks of at most about ``block_bytes``; an automaton of all names of a block finds them in one
    pass over a text, so the work is linear in the texts, whatever they mention and however often.
    """
    names = links_.select("key", concept_form(F.col("name")).alias("form")).where(F.length("form") >= 2).distinct()
    asked = queries.select("qid", concept_form(F.col("text")).alias("hay")).where("hay <> ''")
    size = names.agg(F.sum(F.octet_length("key") + F.octet_length("form") + 16).alias("n")).first().n or 0
    blocks = max(1, -(-size * 5 // (4 * block_bytes)))
    if blocks > 1:
        names = kept(names)
    schema = T.StructType([asked.schema["qid"], T.StructField("key", T.StringType())])
    found = None
    for block in range(blocks):
        table = (names if blocks == 1 else names.where(F.pmod(F.xxhash64("form"), F.lit(blocks)) == block)).toArrow()  # block_bytes
        part = asked.mapInArrow(_finder(queries.sparkSession.sparkContext.broadcast(list(zip(table["form"].to_pylist(), table["key"].to_pylist(), strict=True)))), schema)
        found = part if found is None else found.unionAll(part)
    return found.distinct()


def _finder(names: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, list[str]] = {}
        for form, key in names.value:
            keys.setdefault(f" {form} ", []).append(key)
        words = ahocorasick.Automaton()
        for form, own in keys.items():
            words.add_word(form, own)
        words.make_automaton()
        for batch in batches:
            rows, said = [], []
            for k, hay in enumerate(batch.column(1).to_pylist() if keys else ()):
                met = {key for _, own in words.iter(f" {hay} ") for key in own}
                rows += [k] * len(met)
                said += met
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(said, pa.string())], names=["qid", "key"])

    return find


def traverse(links_: DataFrame, edges_: DataFrame, queries: DataFrame, top_n: int = 10, min_overlap: int = MIN_OVERLAP, neighbours: int = NEIGHBOURS) -> DataFrame:
    """qid, paper_id, total, direct and rank from links (key, name, paper_id) and queries (qid, text).

    Concepts that a query mentions, in any of its texts, and the strongest ``neighbours`` of each are looked up, in blocks of
    ``LOOKED_BYTES`` for all tasks; papers with at least ``min_overlap`` of them are ranked by mentioned ones, then all.
    """
    met = mentioned(links_, queries).groupBy("qid").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    # queries that mention the same concepts find the same papers: each set of concepts is looked up once, under its first query
    asked = kept(met.withColumn("own", F.min("qid").over(Window.partitionBy("keys"))))
    direct = asked.where("qid = own").select("qid", F.explode("keys").alias("key"))
    both = edges_.select(F.col("src").alias("key"), F.col("dst").alias("next"), "weight").unionAll(edges_.select(F.col("dst").alias("key"), F.col("src").alias("next"), "weight"))
    order = Window.partitionBy("qid", "key").orderBy(F.desc("weight"), "next")
    around = direct.join(both, "key").withColumn("n", F.row_number().over(order)).where(F.col("n") <= neighbours).select("qid", F.col("next").alias("key"))
    expanded = kept(direct.withColumn("own", F.lit(1)).unionAll(around.withColumn("own", F.lit(0))).groupBy("qid", "key").agg(F.max("own").alias("own")))
    size = expanded.agg(F.sum(F.octet_length("key") + 40).alias("n")).first().n or 0
    blocks = max(1, -(-size // LOOKED_BYTES))
    # a paper's rows lie in one task, so what is counted of it needs no shuffle, and each task keeps the first of each query
    held = links_.select("key", "paper_id").repartition("paper_id").distinct()
    best = Window.partitionBy("qid").orderBy(F.desc("direct"), F.desc("total"), "paper_id")
    found = None
    for block in range(blocks):
        part = expanded if blocks == 1 else expanded.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        counted = held.join(F.broadcast(part), "key").groupBy("qid", "paper_id").agg(F.count("*").alias("total"), F.sum("own").alias("direct")).where(F.col("total") >= min_overlap)  # LOOKED_BYTES
        first = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)
        found = first if found is None else found.unionAll(first)
    shared = asked.select(F.col("qid").alias("_qid"), F.col("own").alias("qid"))
    return found.join(shared, "qid").select(F.col("_qid").alias("qid"), "paper_id", "total", "direct", "rank")


def parse_response(raw: DataFrame, column: str = "raw", ids: str = "ids", per_paper: int | None = PER_PAPER) -> DataFrame:
    """paper_id and concepts from model answers, each with the ``ids`` it was asked for: a JSON object, maybe with text around it.

    Unknown papers, unnamed or overlong concepts and repeats by case folding are left out, types outside ``TYPES`` become
    "other", and a paper keeps its first ``per_paper`` concepts (None: all). Concepts may be objects or plain strings.
    """
    body = json_object(F.col(column), "struct<papers:array<struct<arxiv_id:string,concepts:array<string>>>>")
    papers = raw.select(F.col(ids).alias("ids"), F.explode(body["papers"]).alias("p")).where(F.array_contains("ids", F.col("p.arxiv_id")))
    known = papers.select(F.col("p.arxiv_id").alias("paper_id"), F.col("p.concepts").alias("cs"))

    def concept(c):
        parsed = F.from_json(c, "struct<name:string,type:string>")
        name = concept_name(F.coalesce(parsed["name"], F.when(~F.startswith(F.trim(c), F.lit("{")), c)))
        kind = F.lower(parsed["type"])
        return F.struct(name.alias("name"), F.when(kind.isin(*TYPES), kind).otherwise("other").alias("type"))

    named = known.select("paper_id", F.filter(F.transform("cs", concept), lambda c: c["name"].isNotNull()).alias("cs"))
    folded = named.select("paper_id", F.posexplode("cs").alias("at", "c")).withColumn("key", casefold(F.col("c.name")))
    first = folded.groupBy("paper_id", "key").agg(F.min(F.struct("at", "c")).alias("f")).groupBy("paper_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    every = F.transform("fs", lambda f: f["c"])
    kept = first.select("paper_id", (every if per_paper is None else F.slice(every, 1, per_paper)).alias("concepts"))
    return known.select("paper_id").distinct().join(kept, "paper_id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<struct<name:string,type:string>>")))
