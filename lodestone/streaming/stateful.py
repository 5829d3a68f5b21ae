"""Timers and answers for each event: trailing edges that fire without a later event, and the count of each request.

State is a few numbers for each key and goes by timers. Streams with it need the RocksDB state store, which
``store`` sets, and a trigger by processing time: timers of the clock keep an available-now run from ending.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Debounce(StatefulProcessor):
    """One row for each burst of a key's events, when none has come for ``gap`` milliseconds."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "events long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = sum(map(len, rows))
        if self.burst.exists():
            before, timer = self.burst.get()
            self.handle.deleteTimer(timer)
            events += before
        timer = timerValues.getCurrentProcessingTimeInMs() + self.gap
        self.handle.registerTimer(timer)
        self.burst.update((events, timer))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        events, _ = self.burst.get()
        self.burst.clear()
        yield pd.DataFrame({"key": [key[0]], "events": [events], "fired_at": [expiredTimerInfo.getExpiryTimeInMs()]})

    def close(self) -> None:
        pass


def trailing_edges(events: DataFrame, key: str, gap: int) -> DataFrame:
    """(key, events, fired_at) of a stream of events: the end of each burst, ``gap`` milliseconds of the clock after its last event."""
    store(events.sparkSession)
    rows = events.select(F.col(key).cast("string").alias("key"))
    return rows.groupBy("key").transformWithStateInPandas(Debounce(gap), "key string, events long, fired_at long", "Append", "ProcessingTime")


class Limit(StatefulProcessor):
    """Counts requests of a key and window one by one; the count goes when none has come for a window's length."""

    def __init__(self, limit: int, length: int) -> None:
        self.limit, self.length = limit, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "requests long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        requests, timer = self.count.get() if self.count.exists() else (0, None)
        for frame in rows:
            frame = frame.sort_values(["time", "request"], kind="stable")
            counts = range(requests + 1, requests + len(frame) + 1)
            requests += len(frame)
            yield pd.DataFrame({"key": frame.key, "request": frame.request, "time": frame.time, "window_start": frame.window_start, "requests": list(counts), "remaining": [max(0, self.limit - n) for n in counts], "allowed": [n <= self.limit for n in counts]})
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.length
        self.handle.registerTimer(timer)
        self.count.update((requests, timer))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def decisions(requests: DataFrame, key: str, request: str, time: str, unit: str, limit: int) -> DataFrame:
    """(key, request, time, window_start, requests, remaining, allowed, reset_at): an answer to each request of a stream.

    Windows are calendar hours or days (``unit``) of the request's time. Requests that come together are counted
    in the order of their times; one that comes later counts later, whatever its time.
    """
    store(requests.sparkSession)
    length = {"hour": 3_600_000, "day": 86_400_000}[unit]
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(request).cast("string").alias("request"), F.col(time).cast("timestamp").alias("time"), F.date_trunc(unit, time).alias("window_start"))
    schema = "key string, request string, time timestamp, window_start timestamp, requests long, remaining long, allowed boolean"
    counted = rows.groupBy("key", "window_start").transformWithStateInPandas(Limit(limit, length), schema, "Append", "ProcessingTime")
    return counted.withColumn("reset_at", F.col("window_start") + F.make_dt_interval(F.lit(0), F.lit(length // 3_600_000)))
