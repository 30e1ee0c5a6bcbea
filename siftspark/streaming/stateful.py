"""Stateful operators on typed state: a sliding limit, and impressions once per delay, whose state leaves by timers and time to live.

They need a session whose state store is RocksDB (`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor


class Limiter(StatefulProcessor):
    """The times of a key's let-through requests as a list state; a timer clears it once they are out of the window."""

    def __init__(self, key: str, at: str, seconds: int, most: int):
        self.key, self.at, self.seconds, self.most = key, at, seconds, most

    def init(self, handle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "t double")

    def _later(self, times: list[float]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(int((times[-1] + self.seconds) * 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        out = []
        for t in sorted(t for f in rows for t in f[self.at]):
            s = t.timestamp()
            recent = [r for r in recent if r >= s - self.seconds]
            out.append((key[0], t, len(recent), len(recent) < self.most))
            if len(recent) < self.most:
                recent.append(s)
        self.recent.put([(r,) for r in recent])
        self._later(recent)
        yield pd.DataFrame(out, columns=[self.key, self.at, "in_window", "allowed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.recent.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        times = sorted(t.timestamp() for t in initialState[self.at])[-self.most :]
        self.recent.put([(t,) for t in times])
        self._later(times)

    def close(self) -> None:
        pass


def limited(events: DataFrame, key: str, at: str = "ts", seconds: int = 60, most: int = 60, late: str = "1 hour", before: DataFrame | None = None) -> DataFrame:
    """(key, at, in_window, allowed): a sliding limit over a stream; refused requests don't count.

    before: let-through requests (key, at) of a batch table that the stream begins with. Requests older than the
    watermark are dropped; a key's state is cleared by a timer when the watermark passes its last request by the window.
    """
    kind = events.schema[key].dataType.simpleString()
    start = before.groupBy(key) if before is not None else None
    return events.withWatermark(at, late).groupBy(key).transformWithStateInPandas(Limiter(key, at, seconds, most), f"{key} {kind}, {at} timestamp, in_window long, allowed boolean", "Append", "EventTime", start)


class Once(StatefulProcessor):
    """A map state of the items that a key has shown, each with a time to live."""

    def __init__(self, columns: list[str], item: str, at: str, hours: int):
        self.columns, self.item, self.at, self.hours = columns, item, at, hours

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "item string", "at double", ttlDurationMs=self.hours * 3_600_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        frame = pd.concat(list(rows)).sort_values(self.at, kind="stable")
        keep = []
        for item, t in zip(frame[self.item].astype(str), frame[self.at], strict=True):
            keep.append(not self.seen.containsKey((item,)))
            if keep[-1]:
                self.seen.updateValue((item,), (t.timestamp(),))
        yield frame.loc[keep, self.columns]

    def close(self) -> None:
        pass


def impressions_once(events: DataFrame, key: str, item: str, at: str = "ts", hours: int = 24) -> DataFrame:
    """The first event of each key's item; an item may appear again once `hours` of processing time have passed without it in the state."""
    return events.groupBy(key).transformWithStateInPandas(Once(events.columns, item, at, hours), events.schema, "Append", "ProcessingTime")
