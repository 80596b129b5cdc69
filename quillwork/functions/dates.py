"""Dates, periods and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRANULARITIES = ("week", "month", "year")


def period(ts: Column, granularity: str) -> Column:
    """Label of a period: yyyy, yyyy-MM or ISO year and week."""
    if granularity == "month":
        return F.date_format(ts, "yyyy-MM")
    if granularity == "year":
        return F.date_format(ts, "yyyy")
    if granularity == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    raise ValueError(f"granularity must be one of {GRANULARITIES}, not {granularity!r}")


def between_days(df: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    """Rows from the first to the last day, both included; a bound that is not given adds no predicate."""
    if first is not None:
        df = df.where(F.col(column) >= F.lit(first).cast("timestamp"))
    if last is not None:
        df = df.where(F.col(column) < F.lit(last).cast("timestamp") + F.expr("interval 1 day"))
    return df


def parse(text: Column, fallback: Column | None = None) -> Column:
    """A timestamp from ISO-8601 text; what does not parse becomes the fallback, or now."""
    parsed = text.try_cast("timestamp")
    return F.coalesce(parsed, *([fallback] if fallback is not None else []), F.current_timestamp())


def windows(df: DataFrame, start: str = "date_from", end: str = "date_to", days: int = 7) -> DataFrame:
    """``df`` with a row for each span of ``days`` days, the last one cut off at ``end``."""
    starts = F.expr(f"sequence(to_date({start}), to_date({end}), interval {int(days)} days)")
    return df.withColumn("win_start", F.explode(starts)).withColumn("win_end", F.least(F.date_add("win_start", days - 1), F.to_date(end)))


def compact(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)
