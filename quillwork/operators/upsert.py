"""Keyed writes as functions from tables to tables: upsert, insert-ignore, links, seeds and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(source: DataFrame, keys: list[str], version: str, *ties: str) -> DataFrame:
    """One row per key: the highest version, then the highest of the tie columns. Aggregated before the shuffle."""
    rest = [c for c in source.columns if c not in {version, *ties}]
    best = F.max(F.struct(version, *ties, *rest)).alias("r")
    return source.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best).select(*[F.col(f"r.{c}").alias(c) for c in source.columns])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], version: str, fixed: tuple[str, ...] = (), ties: tuple[str, ...] = ()) -> DataFrame:
    """``target`` with the rows of ``source``, and ``action``: insert, update or unchanged.

    A row replaces its counterpart only with a higher version; ``fixed`` columns keep their first value. Of rows
    with the same key in ``source``, the latest counts. A null version, on either side, is not newer and not older: the
    stored row stays. Null keys equal each other.
    """
    new = latest(source, keys, version, *ties)
    t, s = target.withColumn("_there", F.lit(True)).alias("t"), new.alias("s")
    both = t.join(s, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], "full")
    there = F.col("t._there").isNotNull()
    newer = there & F.coalesce(F.col(f"t.{version}") < F.col(f"s.{version}"), F.lit(False))
    action = F.when(~there, "insert").when(newer, "update").otherwise("unchanged")

    def value(c: str) -> Column:
        mine, theirs = F.col(f"t.{c}"), F.col(f"s.{c}")
        if c in keys:
            return F.when(there, mine).otherwise(theirs)
        return F.when(~there, theirs).otherwise(mine) if c in fixed else F.when(~there | newer, theirs).otherwise(mine)

    return both.select(*[value(c).alias(c) for c in target.columns], action.alias("action"))


def actions(upserted: DataFrame) -> DataFrame:
    return upserted.groupBy("action").agg(F.count("*").alias("n_rows"))


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` and the first row, in ``order``, of every key that it lacks."""
    rest = [c for c in target.columns if c not in keys]
    first = source.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]) if rest else F.lit(1), F.struct(*order)).alias("r"))
    new = first.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return target.unionByName(new.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def with_ids(target: DataFrame, source: DataFrame, key: str, name: str, order: list[str], id_: str = "id", above: int | None = None) -> DataFrame:
    """``target`` (id, name, key) with new keys of ``source`` under the next free ids, in key order; the first spelling stays.
    ``above``: the highest id given so far, where ``target`` is only a part of the table.

    Ids come from counts per hash range of the new keys and a rank within each, so no task ranks all of them.
    """
    first = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(name, F.struct(*order)).alias(name))
    new = first.join(target.select(key), key, "left_anti").withColumn("_part", F.pmod(F.xxhash64(key), F.lit(1024)))
    counts = new.groupBy("_part").count()
    bases = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_base"))  # 1024 rows at most
    highest = F.coalesce(F.max(id_), F.lit(0)) if above is None else F.lit(above)
    top = target.agg(highest.cast("long").alias("_top"))
    ranked = new.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(key)))
    given = ranked.join(F.broadcast(bases), "_part").crossJoin(F.broadcast(top))
    return target.unionByName(given.select((F.col("_top") + F.col("_base") + F.col("_rank")).cast("long").alias(id_), name, key))


def author_links(papers: DataFrame, authors: DataFrame, normalise) -> DataFrame:
    """paper_id, author_id and position (from 0); an author named twice keeps the first position."""
    named = papers.select(F.col("arxiv_id").alias("paper_id"), F.posexplode("authors").alias("position", "name"))
    keyed = named.withColumn("name_normalized", normalise(F.col("name")))
    return keyed.join(authors.select(F.col("id").alias("author_id"), "name_normalized"), "name_normalized").groupBy("paper_id", "author_id").agg(F.min("position").cast("short").alias("position"))


def category_links(papers: DataFrame) -> DataFrame:
    """paper_id, category_code and is_primary; the primary one is the declared, else the first."""
    declared = F.coalesce(F.nullif(F.col("primary_category"), F.lit("")), F.get("categories", 0), F.lit(""))
    exploded = papers.select(F.col("arxiv_id").alias("paper_id"), declared.alias("primary"), F.explode("categories").alias("category_code"))
    return exploded.select("paper_id", "category_code", (F.col("category_code") == F.col("primary")).alias("is_primary")).distinct()


def seed(target: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``target`` with ``column`` set from ``values``, and the keys that it lacks."""
    new = values.select(key, F.col(column).alias("_new"))
    return target.join(new, key, "full").withColumn(column, F.coalesce("_new", column)).select(*target.columns)


def update_columns(target: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``target`` with the non-null values of the other columns of ``values``."""
    columns = [c for c in values.columns if c != key]
    renamed = values.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def pending(papers: DataFrame, model: str, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector is missing, of another model or older than the row."""
    return papers.where(F.col(embedding).isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)) | (F.col("embedding_updated_at") < F.col("updated_at")))


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def latest_run(runs: DataFrame, key: str = "id") -> DataFrame:
    """The row with the highest key, by aggregation."""
    return runs.agg(F.max_by(F.struct(*runs.columns), key).alias("r")).where("r is not null").select("r.*")
