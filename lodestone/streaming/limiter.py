"""The sliding-window limiter on a stream: state is the accepted times of a key, dropped when event time is a window past the last."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The state store that keeps lists and timers: the session must name it before a stream with `limit_by_timers` starts.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def limit(requests: DataFrame, most: int = 100, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """(id, key, accepted) of requests (id long, key string, ts timestamp). Within a micro-batch requests are taken in time order.
    State goes by event time: a key is forgotten when the watermark (`late` behind the latest time) is a window past its last
    accepted request, so results don't depend on when batches run. Requests later than the watermark are dropped."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out = []
        for t in rows.ts.astype("datetime64[us]").astype("int64"):
            held = [h for h in held if h > t - seconds * 1_000_000]
            out.append(len(held) < most)
            if out[-1]:
                held.append(int(t))
        state.update((held,))
        state.setTimeoutTimestamp(max([*held, int(rows.ts.max().value // 1000)], default=0) // 1000 + seconds * 1000)
        yield pd.DataFrame({"id": rows.id.to_numpy(), "key": key[0], "accepted": out})

    timed = requests.withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(step, "id long, key string, accepted boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


class _Window(StatefulProcessor):
    """Accepted times of a key as a list in the state store; a timer of event time clears it when the last has left the window."""

    def __init__(self, most: int, seconds: int):
        self.most, self.span = most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = [t for (t,) in self.held.get()]
        new = pd.concat(list(rows)).sort_values(["ts", "id"])
        out = []
        for t in new.ts.astype("datetime64[us]").astype("int64"):
            held = [h for h in held if h > t - self.span]
            out.append(len(held) < self.most)
            if out[-1]:
                held.append(int(t))
        self._lives_until(max(held, default=int(new.ts.astype("datetime64[us]").astype("int64").max())))
        if held:
            self.held.put([(t,) for t in held])
        else:
            self.held.clear()
        yield pd.DataFrame({"id": new.id.to_numpy(), "key": key[0], "accepted": out})

    def _lives_until(self, last: int) -> None:
        """One timer a key, a millisecond after the last accepted time has left the window."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((last + self.span) // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_by_timers(requests: DataFrame, most: int = 100, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """As `limit`, with list state and event-time timers (transformWithState): the state of a key lives until the watermark is a window
    past its last accepted request, and no key is looked at in a batch that has nothing for it. The number of keys that are
    held follows from that lifetime, so there is no other bound on it. Requests that repeat count each."""
    timed = requests.withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(_Window(most, seconds), "id long, key string, accepted boolean", "Append", "EventTime")
