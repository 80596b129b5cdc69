"""Incremental processing: checkpoints of windows, and streams into keyed tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONDAY = "4 days"  # windows count from a Thursday


def tumbling(events: DataFrame, ts: str = "ts", width: str = "7 days", offset: str = MONDAY, late: str | None = None, *keys: str) -> DataFrame:
    """Counts and sums by window and keys, for batches and streams. ``late`` sets the watermark of a stream."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width, width, offset), *keys).agg(F.count("*").alias("n_rows"))


def latest_version(events: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key; aggregated before the shuffle."""
    rest = [c for c in events.columns if c != version]
    return events.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(version, *rest)).alias("r")).select("r.*").select(*events.columns)


def deduplicated(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key once within the watermark, so state stays bounded."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def window_key(category: Column, start: Column) -> Column:
    return F.concat_ws(":", category, start)


def todo(windows: DataFrame, done: DataFrame) -> DataFrame:
    """Windows (category, win_start, ...) that are not done yet."""
    return windows.join(done.select("category", "win_start").distinct(), ["category", "win_start"], "left_anti")


def complete(checkpoint: Column, category: Column, start: Column) -> Column:
    """A checkpoint with one more window done and nothing under way."""
    done = F.array_union(F.coalesce(checkpoint["done"], F.array().cast("array<string>")), F.array(window_key(category, start)))
    return F.struct(done.alias("done"), F.lit(None).cast("struct<category:string,date_window:string,offset:int>").alias("current"))


def progress(checkpoint: Column, category: Column, start: Column, offset: Column) -> Column:
    """A checkpoint with one window under way, ``offset`` rows of it done."""
    current = F.struct(category.cast("string").alias("category"), start.cast("string").alias("date_window"), offset.cast("int").alias("offset"))
    return F.struct(F.coalesce(checkpoint["done"], F.array().cast("array<string>")).alias("done"), current.alias("current"))


def resume_offset(checkpoint: Column, category: Column, start: Column) -> Column:
    now = checkpoint["current"]
    return F.coalesce(F.when((now["category"] == category) & (now["date_window"] == start), now["offset"]), F.lit(0))


def into_tables(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``apply`` on every micro-batch of what is there, then stops. Applying a batch twice must change nothing."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def until_idle(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """As ``into_tables``, for sources that cannot tell in advance what is there: batch by batch until nothing new comes."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
