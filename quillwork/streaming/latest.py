"""The last version of every key of a stream, in state that is bounded by the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Latest(StatefulProcessor):
    """Holds a key's highest version (a time, then ties) and emits the row whenever it rises. A timer drops the key when the
    watermark has passed its version: no row that is still let in can be older."""

    def __init__(self, columns: list[str], order: list[str]):
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = [T.StructField("at", T.LongType()), *(T.StructField(f"tie{k}", T.StringType()) for k in range(len(self.order) - 1))]
        self.held = handle.getValueState("held", T.StructType(kinds))

    def _version(self, row) -> tuple:
        return (int(row[self.order[0]]), *(str(row[t]) for t in self.order[1:]))

    def _due(self, version: tuple) -> int:
        """The millisecond behind a version."""
        return version[0] // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        best, new = held, None
        for frame in rows:
            top = frame.sort_values(self.order).iloc[-1]
            version = self._version(top)
            if best is None or version > best:
                best, new = version, frame.loc[[top.name]]
        if new is None:
            return
        self.held.update(best)
        if held is None or held[0] != best[0]:
            if held is not None:
                self.handle.deleteTimer(self._due(held))
            self.handle.registerTimer(self._due(best))
        yield new[self.columns].reset_index(drop=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and self._due(self.held.get()) <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def latest_stream(stream: DataFrame, key: str, version: str, ties: tuple[str, ...] = (), late: str = "7 days") -> DataFrame:
    """Rows of ``stream`` that are the last version of their key when they come: the highest time ``version``, then the highest
    ``ties`` (compared as numbers if they are). Written with an upsert by key they leave what ``latest_version`` leaves.

    Rows of a null key or version, and rows later than ``late``, are left out. State has one version a key, dropped once
    the watermark has passed it. Needs the RocksDB state store.
    """
    timed = stream.where(F.col(key).isNotNull() & F.col(version).isNotNull()).withColumn(version, F.col(version).cast("timestamp")).withWatermark(version, late)
    width = lambda t: F.lpad((F.col(t).cast("decimal(38,0)") + F.lit("1" + "0" * 30).cast("decimal(38,0)")).cast("string"), 38, "0")
    plain = {f.name: f.dataType for f in timed.schema.fields}
    names, order = stream.columns, ["quillwork_at", *(f"quillwork_tie{k}" for k in range(len(ties)))]  # Spark renames columns with a leading underscore here
    values = [F.unix_micros(version), *(F.coalesce(width(t) if isinstance(plain[t], T.IntegralType) else F.col(t).cast("string"), F.lit("")) for t in ties)]
    tied = timed.withColumns(dict(zip(order, values, strict=True)))
    schema = T.StructType([f for f in timed.schema.fields if f.name in names])
    return tied.groupBy(key).transformWithStateInPandas(Latest(names, order), schema, "Update", "EventTime")
