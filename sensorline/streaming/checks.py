"""The stream checks over live recordings, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and lists need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_rates(events: DataFrame, key: str, clock: str, window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """n, rate_hz and the first and last time of each key and window; rows later than the watermark are left out."""
    seconds = F.expr(f"unix_seconds(to_timestamp('1970-01-01') + interval {window})")
    rows = events.withWatermark(clock, late).groupBy(F.window(clock, window), key).agg(F.count("*").alias("n"), F.min(clock).alias("first"), F.max(clock).alias("last"))
    return rows.select(key, F.col("window.start").alias("start"), "n", (F.col("n") / (seconds - F.expr("unix_seconds(to_timestamp('1970-01-01'))"))).alias("rate_hz"), "first", "last")


def live_gaps(events: DataFrame, key: str, clock_ns: str, limit_ns: int) -> DataFrame:
    """Gaps above a limit as they happen, and how often a stream has gone backwards: key, start_ns, end_ns, n_disorder.

    The state of a key is its last time and a count. A batch's rows of a key are taken in the order of the clock.
    """
    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, disorder = state.get if state.exists else (None, 0)
        times = np.sort(pd.concat([p[clock_ns] for p in parts]).dropna().to_numpy("int64"))
        if last is not None:
            disorder += int((times < last).sum())
            times = np.concatenate([[last], times[times >= last]])
        after = np.flatnonzero(np.diff(times) > limit_ns) + 1
        if len(times):
            state.update((int(times[-1]), disorder))
        yield pd.DataFrame({key: [k[0]] * len(after), "start_ns": times[after - 1], "end_ns": times[after], "n_disorder": np.full(len(after), disorder)})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, clock_ns).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, start_ns bigint, end_ns bigint, n_disorder bigint", "last bigint, disorder bigint", "append", GroupStateTimeout.NoTimeout
    )


class HeldGaps(StatefulProcessor):
    """Holds a stream's times until the watermark has passed them, so that rows that come late but in time are no disorder.

    A timer a second releases what lies behind it, in the order of the clock; one more ends a stream that has been silent for idle_ms
    and forgets it. The state of a key is its last released time and what is held, which the watermark bounds.
    """

    def __init__(self, key: str, limit_ns: int, idle_ms: int):
        self.key, self.limit, self.idle = key, limit_ns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint")
        self.held = handle.getListState("held", "t bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = np.concatenate([p["t"].dropna().to_numpy("int64") for p in rows])
        for t in times.tolist():
            self.held.appendValue((t,))
        for second in np.unique(times // 1_000_000_000).tolist():
            self.handle.registerTimer((second + 1) * 1_000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1_000_000
        held = np.sort(np.array([r[0] for r in self.held.get()], np.int64))
        free, kept = held[held < now], held[held >= now]
        last = self.last.get()[0] if self.last.exists() else None
        if len(free):
            if len(kept):
                self.held.put([(t,) for t in kept.tolist()])
            else:
                self.held.clear()
            times = free if last is None else np.concatenate([[last], free])
            after = np.flatnonzero(np.diff(times) > self.limit) + 1
            self.last.update((int(times[-1]),))
            self.handle.registerTimer(int(times[-1]) // 1_000_000 + self.idle + 1)
            return self._rows(key, "gap", times[after - 1].tolist(), times[after].tolist())
        if last is not None and not len(kept) and last + self.idle * 1_000_000 < now:
            self.last.clear()
            return self._rows(key, "end", [last], [None])
        return iter(())

    def _rows(self, key: tuple, event: str, start: list, end: list) -> Iterator[pd.DataFrame]:
        columns = {self.key: [key[0]] * len(start), "event": [event] * len(start), "start_ns": start, "end_ns": end}
        return iter([pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})] if start else [])

    def close(self) -> None:
        pass


def held_gaps(events: DataFrame, key: str, clock_ns: str, limit_ns: int, late: str = "10 seconds", idle_ms: int = 600_000) -> DataFrame:
    """Gaps above a limit, and streams that have ended, once the watermark tells that nothing more can come between: key, event (gap or
    end), start_ns, end_ns (null for an end).

    Rows up to ``late`` behind the newest are sorted in; later ones are left out by the watermark. A stream that is silent for idle_ms of
    event time has ended; if it goes on it begins anew.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = events.where(F.col(clock_ns).isNotNull()).select(key, F.col(clock_ns).cast("bigint").alias("t"), F.timestamp_micros((F.col(clock_ns) / 1000).cast("bigint")).alias("_at"))
    kind = events.schema[key].dataType.simpleString()
    return rows.withWatermark("_at", late).groupBy(key).transformWithStateInPandas(
        HeldGaps(key, limit_ns, idle_ms), f"{key} {kind}, event string, start_ns bigint, end_ns bigint", "Append", "eventTime"
    )
