"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import fresh


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; only where none is named, its warehouse."""
    context = spark.sparkContext
    return context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")


@contextmanager
def step(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """What holds while a table between two steps is written; then the session is as it was.

    Arrow batches have at most ``rows`` rows (Spark bounds them by bytes besides; a smaller setting of the user's stays), and the
    write's shuffle files go when it ends: nothing reads them again.
    """
    batch, clean = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = {key: spark.conf.get(key) for key in (batch, clean)}
    most = int(held[batch])
    spark.conf.set(batch, str(min(rows, most) if most > 0 else rows))
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


class Scratch:
    """Tables that cut the lineage of a job of many steps, so that a lost executor costs one step.

    As a context it deletes at its end what it wrote, but for the tables that ``keep`` names: those that the result reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/quillwork-{uuid.uuid4().hex}", {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(*self.paths.values())

    def cut(self, df: DataFrame) -> DataFrame:
        """``df``, written as Parquet and read again."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        with step(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, a table of this scratch that now outlives it."""
        self.paths.pop(id(df))
        return df

    def result(self, df: DataFrame) -> DataFrame:
        """``df``, computed and held as a checkpoint, which reads no table of this scratch. Spark's cleaner deletes checkpoints that
        nothing refers to if the session asks for that (spark.cleaner.referenceTracking.cleanCheckpoints). A session
        without a checkpoint folder gets one in its warehouse."""
        context = self.spark.sparkContext
        if not context.getCheckpointDir():
            context.setCheckpointDir(f"{shared_folder(self.spark)}/quillwork-checkpoints")
        return df.checkpoint()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        self._delete(*(self.paths.pop(id(t)) for t in tables))

    def _delete(self, *paths: str) -> None:
        for path in paths:
            there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


def split(df: DataFrame, column: str, wanted: DataFrame, wanted_column: str, bits: int = 23) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``column`` may be among ``wanted`` (all that are, and few others), and the rest.

    A bitmap of 2**bits hash values, a fixed size for any input, is sent to all tasks, so that a join with few keys
    need not shuffle what cannot match. Nulls go with the rest. ``wanted`` is read twice: cut it first.
    """
    part, bit, words = (fresh(df, name) for name in ("_part", "_bit", "_words"))
    hashed = lambda c: f"pmod(xxhash64(`{c}`), {1 << bits}L)"
    marked = wanted.where(F.col(wanted_column).isNotNull()).select(F.expr(hashed(wanted_column)).alias("p")).groupBy(F.expr("p div 32768").alias(part)).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bitmap"))
    marked = marked.select(part, F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.conv(F.hex(F.substring("bitmap", i + 1, 1)), 16, 10).cast("smallint")).alias(words))
    placed = df.withColumn(part, F.expr(f"{hashed(column)} div 32768")).withColumn(bit, F.expr(f"cast({hashed(column)} % 32768 as int)"))
    held = F.expr(f"(get(`{words}`, shiftright(`{bit}`, 3)) & shiftleft(1, `{bit}` & 7)) <> 0")
    joined = placed.join(F.broadcast(marked), part, "left").withColumn(bit, F.coalesce(held, F.lit(False)) & F.col(f"`{column}`").isNotNull())  # at most 2**bits bits
    columns = [F.col(f"`{c}`") for c in df.columns]
    return joined.where(F.col(bit)).select(*columns), joined.where(~F.col(bit)).select(*columns)


def holding(df: DataFrame, column: str, wanted: DataFrame, wanted_column: str, bits: int = 23) -> DataFrame:
    """The rows of ``df`` that may match ``wanted``."""
    return split(df, column, wanted, wanted_column, bits)[0]
