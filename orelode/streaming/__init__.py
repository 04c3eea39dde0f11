"""Structured Streaming operators, each with a batch twin that gives the same rows.

State is one small value per key, held by ``transformWithState``; a timer in
event time takes it away once the watermark has passed the key's last row by
``ttl``, so keys that come and go leave nothing behind. What a key's next row
means depends on its own time only, not on when the timer fired.

These operators need Spark's RocksDB state store; ``with_state_store`` names it
in the session of the stream if the session has another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(stream: DataFrame) -> DataFrame:
    if stream.sparkSession.conf.get(STORE) != ROCKS:
        stream.sparkSession.conf.set(STORE, ROCKS)
    return stream


def micros(t: pd.Timestamp) -> int:
    return int(pd.Timestamp(t).value // 1000)


class _PerKey(StatefulProcessor):
    """A value per key and one timer that ends it: ``ttl_ms`` after the key's newest row (0: never)."""

    schema = ""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.schema)

    def keep(self, value: tuple, newest: int, timers: TimerValues) -> None:
        """Store the value and move the key's timer to ``newest`` (microseconds) plus the time to live."""
        self.value.update(value)
        if self.ttl_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            # A timer must lie after the watermark.
            self.handle.registerTimer(max(newest // 1000 + self.ttl_ms + 1, timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        yield from ()

    def close(self) -> None:
        pass


class _Changes(_PerKey):
    schema = "last string, at long"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "hash"], kind="stable")
        last, at = self.value.get() if self.value.exists() else (None, None)
        keep = []
        for h, t in zip(new["hash"], map(micros, new["ts"]), strict=True):
            known = at is not None and not (self.ttl_ms and t - at > self.ttl_ms * 1000)
            keep.append(not known or h != last)
            last, at = h, t
        self.keep((last, at), at, timerValues)
        yield new[keep][["key", "hash", "ts"]]


def change_feed(stream: DataFrame, lateness: str = "0 seconds", ttl_s: float = 0.0) -> DataFrame:
    """Rows of ``stream(key, hash, ts)`` whose hash differs from the key's last one, or whose key was silent for over ``ttl_s`` (0: never forgotten)."""
    rows = with_state_store(stream).select("key", "hash", "ts").withWatermark("ts", lateness)
    return rows.groupBy("key").transformWithStateInPandas(_Changes(int(ttl_s * 1000)), "key string, hash string, ts timestamp", "append", "eventTime")


def change_feed_batch(df: DataFrame, ttl_s: float = 0.0) -> DataFrame:
    w = Window.partitionBy("key").orderBy("ts", "hash")
    first, changed = F.lag("ts").over(w).isNull(), ~F.lag("hash").over(w).eqNullSafe(F.col("hash"))
    silent = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) > int(ttl_s * 1e6) if ttl_s else F.lit(False)
    return df.select("key", "hash", "ts", (first | changed | F.coalesce(silent, F.lit(False))).alias("_new")).where("_new").drop("_new")


class _InOrder(_PerKey):
    schema = "top long, late long"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["id", "ts"], kind="stable")
        top, late = self.value.get() if self.value.exists() else (None, 0)
        keep = []
        for t in new["ts"]:
            at = None if pd.isna(t) else micros(t)
            good = at is None or top is None or at >= top
            keep.append(good)
            late += not good
            top = at if good and at is not None else top
        self.keep((top, late), top or 0, timerValues)
        out = new[keep][["line", "id", "ts"]].copy()
        out["dropped"] = late
        yield out


def ordered_line_ingest(stream: DataFrame, lateness: str = "10 minutes", ttl_s: float = 86_400.0) -> DataFrame:
    """line, id, ts, dropped: rows of ``stream(line, id, ts)`` not earlier than the last kept one of their line.

    A row sent again within ``lateness`` counts once; rows of one id with other
    times are rows of their own, the earlier first. dropped is the line's number
    of late rows so far. A line that was silent for ``ttl_s`` beyond the
    watermark is forgotten: rows from before are too late for the stream then,
    and its count starts again.
    """
    fresh = with_state_store(stream).select("line", "id", "ts").withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["line", "id", "ts"])
    return fresh.groupBy("line").transformWithStateInPandas(_InOrder(int(ttl_s * 1000)), "line long, id long, ts timestamp, dropped long", "append", "eventTime")


def ordered_line_batch(df: DataFrame) -> DataFrame:
    from ..operators.lines import order_violation_filter

    once = df.select("line", "id", "ts").distinct()
    return order_violation_filter(once.withColumn("_arrival", F.struct("id", "ts")), "line", "_arrival", "ts").drop("_arrival")


class _Stale(_PerKey):
    schema = "last long"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = max(micros(p["ts"].max()) for p in rows)
        last = max(last, self.value.get()[0]) if self.value.exists() else last
        self.keep((last,), last, timerValues)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            last = self.value.get()[0]
            self.value.clear()
            yield pd.DataFrame({"key": [key[0]], "last_ts": [pd.Timestamp(last, unit="us")]})


def stale_key_detection(stream: DataFrame, timeout_s: float = 30.0, lateness: str = "0 seconds") -> DataFrame:
    """key, last_ts when the watermark passes a key's last row by ``timeout_s`` (30 at least); the key is forgotten then."""
    rows = with_state_store(stream).select("key", "ts").withWatermark("ts", lateness)
    return rows.groupBy("key").transformWithStateInPandas(_Stale(int(max(30.0, timeout_s) * 1000)), "key string, last_ts timestamp", "append", "eventTime")


def stale_key_batch(df: DataFrame, timeout_s: float = 30.0) -> DataFrame:
    """key, last_ts of every gap longer than the timeout: to the key's next row, or to the newest row of all."""
    w = Window.partitionBy("key").orderBy("ts")
    now = df.agg(F.max("ts").alias("_now"))  # one row
    gap = df.select("key", "ts", F.lead("ts").over(w).alias("_next")).crossJoin(F.broadcast(now))
    end = F.coalesce("_next", "_now")
    return gap.where(F.timestamp_diff("MICROSECOND", F.col("ts"), end) > max(30.0, timeout_s) * 1e6).select("key", F.col("ts").alias("last_ts"))
