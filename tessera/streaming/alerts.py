"""Alerts on streams: a condition over windows of event time opens, fires when it has held long enough, and resolves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tessera.operators.telemetry import seconds
from tessera.streaming.telemetry import LATE

#: since, last (starts of windows, in seconds) and number of windows of the span that is open.
_STATE = "since long, last long, n long"
#: The state store that timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Spans(StatefulProcessor):
    """The open span of each group; a timer ends it when the watermark has passed a window without rows."""

    def __init__(self, names: list[str], step: int, least: int):
        self.names, self.step, self.least = names, step, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", _STATE)

    def _change(self, key: tuple, since: int, n: int, what: str) -> list[tuple]:
        return [(*key, pd.Timestamp(since, unit="s"), n, what)] if n >= self.least else []

    def _timer(self, wanted: int | None) -> None:
        for t in self.handle.listTimers():
            if t != wanted:
                self.handle.deleteTimer(t)
        if wanted is not None:
            self.handle.registerTimer(wanted)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        since, last, n = self.span.get() if self.span.exists() else (0, 0, 0)
        # Windows close in order; those of one batch come in any.
        frames = list(rows)
        given = pd.concat(frames)
        for start, holds in sorted(zip(given["start_s"].tolist(), given["holds_now"].tolist(), strict=True)):
            if n and not (holds and start == last + self.step):
                found += self._change(key, since, n, "resolved")
                n = 0
            if holds:
                since, last, n = (start if not n else since), start, n + 1
                if n == self.least:
                    found += self._change(key, since, n, "firing")
        if n:
            self.span.update((since, last, n))
        else:
            self.span.clear()
        self._timer((last + 2 * self.step) * 1000 if n else None)
        yield pd.DataFrame(found, columns=self.names)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        if self.span.exists():
            since, last, n = self.span.get()
            if (last + 2 * self.step) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
                found = self._change(key, since, n, "resolved")
                self.span.clear()
        yield pd.DataFrame(found, columns=self.names)

    def close(self) -> None:
        pass


def closed_windows(events: DataFrame, at: str, bad: Column, *by: str, size: str = "5 minutes", late: str = LATE) -> DataFrame:
    """w, by, n and bad of each window once the watermark has passed it: partial counts meet, whatever a group's size."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *by).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))


def sustained(windows: DataFrame, condition: Column, *by: str, size: str = "5 minutes", hold: str = "10 minutes") -> DataFrame:
    """Changes of alerts over windows (w and other columns) of a stream: by, since, n_windows, change.

    ``firing`` comes when ``condition`` has held in consecutive windows for ``hold``, ``resolved`` with all
    windows of the span when it holds no more: in the next window, or where that one has no rows, when
    the watermark has passed it. A span that was shorter than ``hold`` says nothing. State is a span a
    group, and ends with it; it needs Spark's RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    step, least = seconds(size), -(-seconds(hold) // seconds(size))
    key_fields = [windows.schema[k] for k in by]
    rows = windows.withColumn("start_s", F.unix_timestamp(F.col("w.start"))).withColumn("holds_now", F.coalesce(condition, F.lit(False)))
    rows = rows.select(*by, F.window_time("w").alias("closed_at"), "start_s", "holds_now")
    if not by:
        rows, key_fields = rows.withColumn("all_rows", F.lit(0)), [T.StructField("all_rows", T.IntegerType())]
    keys = [f.name for f in key_fields]
    out = T.StructType([*key_fields, *T.StructType.fromDDL("since timestamp, n_windows long, change string").fields])
    processor = Spans(out.names, step, least)
    alerts = rows.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=out, outputMode="append", timeMode="EventTime")
    return alerts.drop("all_rows")
