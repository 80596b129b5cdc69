"""The queries opN_<name> over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, links, minhash, negatives, oracles, packing, prefix_counts, quality, runs, sharding, substrings, vector_tree

#: The contract's rules, host and path to verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SHARDS = 40
TOKEN_LIMIT = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    placed = sharding.shard(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return placed.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_chats(chat.flatten(turns.withColumn("parts", chat.text_part()))))


def op4_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = prefix_counts.prefix_counts(docs, public_tokenizers.path("word_bpe_49k.json"), budget=TOKEN_LIMIT)
    n = prefix_counts.total_tokens()
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"), (n > TOKEN_LIMIT).alias("over_limit"), F.col("prefix_within").alias("chars_in_limit"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark")).drop("text")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.mark(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_passages"), words.alias("repeated_words"), F.array_sort(F.array_distinct("spans.source")).alias("sources"), "spans")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).drop("text", "longest_repeat")


def op8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.judge(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = packing.token_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(ids, blocks=packing.blocks_for(docs))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _planted(docs: DataFrame) -> DataFrame:
    """The contract's texts: in a tenth of the documents, the words from a place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    listed = docs.withColumn("h", h).withColumn("words", F.filter(F.split(F.when(F.col("h") % 10 == 0, F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n = F.size("words")
    sized = listed.withColumn("n", n).withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.nullif("n", F.lit(0))).cast("int")))
    rest = F.col("n") - F.col("a")
    period = (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, period), F.ceil(rest / period).cast("int"))), 1, rest)
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", 1, F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_planted(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    ahead = lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).when(a["length"] * b["period"] < b["length"] * a["period"], 1).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["period"] - b["period"]).cast("int"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(F.array_sort("runs", ahead), 0).alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op13_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_tree.search(rows, rows.where("vec_id % 20 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_duplicates, op2_shard, op3_chat, op4_prefix_counts, op5_decontaminate, op6_substrings, op7_quality, op8_links, op9_pack, op10_bpe, op11_runs, op12_negatives, op13_vector_tree)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": oracles.CHAT, "op7_quality": oracles.QUALITY, "op8_links": oracles.url_filter(RULES), "op12_negatives": oracles.NEGATIVES}
