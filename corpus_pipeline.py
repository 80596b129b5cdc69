"""The corpus pipeline: five stages over ``documents``, each by one operator of ``quillwork.llm``.

For all stages: an empty table gives an empty table. Columns besides those of ``documents`` (doc_id, text, lang, source,
n_chars) are left out, whatever their names; nulls in lang, source and n_chars pass through. Repeated rows pass as
often as they come, where a stage keeps them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import bpe, decontaminate, minhash, quality, substrings
from quillwork.llm.storage import Scratch, split

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and short texts among them."""
    return quality.quality(docs).where("kept").select(*DOCUMENT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the least id. Rows that share an id are one document and stay or go
    together; rows with a null id and texts without words stay."""
    later = Scratch(spark).cut(minhash.near_duplicates(docs, keep_all=False).where("not is_first").select(F.col("id").alias("doc_id")))
    may, cannot = split(docs.select(*DOCUMENT), "doc_id", later, "doc_id")
    return may.join(later, "doc_id", "left_anti").select(*DOCUMENT).unionByName(cannot)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document of which no word is left goes. Documents go by id, nulls
    last; rows that share an id do not repeat each other. Null texts stay; ``n_chars`` of a cut text is counted anew."""
    left = substrings.remove(substrings.mark(docs)).where((F.size("spans") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none and stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select(*DOCUMENT)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, none for null and empty texts; ids that do not decode to the text would stop the
    job."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    checked = coded.withColumn("n_tokens", F.when(same, F.octet_length("ids") / 4).otherwise(F.raise_error(F.lit("ids do not decode to the text"))).cast("long"))
    return checked.select(*DOCUMENT, "n_tokens", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]
#: Suffix arrays, signatures and tokenizers are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written as Parquet beside the checkpoints and read again."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
