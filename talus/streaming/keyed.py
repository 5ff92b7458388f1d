"""Keyed state with timers: read budgets, and sources that fall silent.

Both are stateful processors of Spark's arbitrary-state operator, whose state lies in RocksDB: `with_state_store` names that store
for the queries that a session starts from then on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Keyed state needs this store; a session's own choice of it stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, ROCKS)


class _Budget(StatefulProcessor):
    """The times of a user's accepted calls within the window, as a list."""

    def __init__(self, user: str, seconds: str, window_s: int, most: int, idle_s: int | None):
        self.user, self.seconds, self.window_s, self.most, self.idle_s = user, seconds, window_s, most, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "at bigint", ttlDurationMs=1000 * self.idle_s if self.idle_s else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A trigger's calls of one user may come in several frames that aren't in order: they are put together first.
        calls = pd.concat(list(rows), ignore_index=True).sort_values([self.seconds, "call"])
        held, allowed = [int(x[0]) for x in self.held.get()] if self.held.exists() else [], []
        for s in calls[self.seconds].tolist():
            held = [h for h in held if h >= s - self.window_s]
            allowed.append(len(held) < self.most)
            if allowed[-1]:
                held.append(int(s))
        if held:
            self.held.put([(h,) for h in held])
        else:
            self.held.clear()
        yield pd.DataFrame({self.user: [key[0]] * len(calls), "call": calls["call"].to_numpy(), "allowed": allowed})

    def close(self) -> None:
        pass


def read_budget(stream: DataFrame, user: str, seconds: str, window_s: int = 300, most: int = 40, idle_s: int | None = None) -> DataFrame:
    """(user, call, allowed): a refused call takes no place in its user's rolling budget. Needs user, seconds (long) and call (long).

    Within a trigger a user's calls are taken by time and call, however they arrive; a null user is a user. Of a user no more than
    `most` times are held, and with idle_s they go when the user was silent so long by the clock, which only a stream that runs as its
    events happen should set."""
    with_state_store(stream.sparkSession)
    kind = stream.schema[user].dataType.simpleString()
    return stream.select(user, seconds, "call").groupBy(user).transformWithStateInPandas(_Budget(user, seconds, window_s, most, idle_s), f"{user} {kind}, call long, allowed boolean", "append", "ProcessingTime" if idle_s else "None")


class _Silence(StatefulProcessor):
    """The last sign of life of a source, and a timer for the time when it would be too long ago."""

    def __init__(self, source: str, limit_ms: int):
        self.source, self.limit_ms = source, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(f.iloc[:, 2].max()) for f in rows)  # by place: names of computed columns don't arrive
        before = int(self.last.get()[0]) if self.last.exists() else None
        if before is None or newest > before:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.limit_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = int(self.last.get()[0])
        self.last.clear()
        yield pd.DataFrame({self.source: [key[0]], "last_ms": [last], "due_ms": [last + self.limit_ms]})

    def close(self) -> None:
        pass


def silent_sources(stream: DataFrame, source: str, ts: str, limit_s: int, delay: str = "0 seconds") -> DataFrame:
    """(source, last_seen, stale_at): a row when the stream's time passes a source's last sign of life by limit_s, though nothing of
    that source arrives; again after it came back and fell silent anew. Rows without a time are no sign of life; a null source is a source."""
    with_state_store(stream.sparkSession)
    kind = stream.schema[source].dataType.simpleString()
    beats = stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(source, ts, F.unix_millis(F.col(ts).cast("timestamp")).alias("__talus_ms"))
    out = beats.groupBy(source).transformWithStateInPandas(_Silence(source, 1000 * limit_s), f"{source} {kind}, last_ms long, due_ms long", "append", "EventTime")
    return out.select(source, F.timestamp_millis("last_ms").alias("last_seen"), F.timestamp_millis("due_ms").alias("stale_at"))
