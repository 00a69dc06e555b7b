"""Status events of tours as a stream in which late events still take their place.

Events are held back in state until the watermark has passed them, and then applied by time and id, so what comes out does not
depend on how the events were split into batches: it is what a replay of all of them gives.  An event that repeats an id
is dropped while its tour is kept.  An event behind the watermark can no longer take its place; it is dropped by the engine, as its watermark says.
A tour without events for ``idle`` is let go; its state starts anew if it comes back.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .tours import COLUMNS, STATE, Tour

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Fold(StatefulProcessor):
    """Held-back events and the tour's state; a timer for the next event that is due and for the end of an idle tour."""

    def __init__(self, navigate: bool, idle_ms: int) -> None:
        self.navigate, self.idle_ms = navigate, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tour = handle.getValueState("tour", "ids array<long>, statuses array<string>, current int, events long, navigations long, last long")
        self.held = handle.getMapState("held", "event_id long", "ts long, action string")
        self.seen = handle.getMapState("seen", "event_id long", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = due = None
        for b in rows:
            for event_id, ts, action, ids, statuses in zip(b["event_id"], b["ts"], b["action"], b["stop_ids"], b["statuses"]):
                first = first or ([int(i) for i in ids], [str(s) for s in statuses])
                if self.seen.containsKey((int(event_id),)):
                    continue
                at = int(ts.timestamp() * 1000)
                self.seen.updateValue((int(event_id),), (at,))
                self.held.updateValue((int(event_id),), (at, str(action)))
                due = at if due is None else min(due, at)
        if not self.tour.exists() and first:
            self.tour.update((*first, 0, 0, 0, 0))
        if due is not None:
            self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((v[0], k[0], v[1]) for k, v in self.held.iterator())
        ready = [e for e in waiting if e[0] <= now]
        ids, statuses, index, n, navigations, last = self.tour.get()
        if ready:
            tour = Tour(list(ids), list(statuses), index, n, navigations)
            for at, event_id, action in ready:
                tour.apply(action, self.navigate)
                self.held.removeKey((event_id,))
            last = ready[-1][0]
            self.tour.update(([int(i) for i in tour.ids], list(tour.statuses), tour.index, tour.events, tour.navigations, last))
            for event_id in [k[0] for k, v in self.seen.iterator() if v[0] + self.idle_ms <= now]:
                self.seen.removeKey((event_id,))  # a repeat that old is behind the watermark
            self.handle.registerTimer(waiting[len(ready)][0] if len(waiting) > len(ready) else last + self.idle_ms)
            yield pd.DataFrame([tour.row(key[0])], columns=COLUMNS)
        elif waiting:
            self.handle.registerTimer(waiting[0][0])
        elif last + self.idle_ms <= now:
            self.tour.clear()
            self.seen.clear()

    def close(self) -> None:
        pass


def ordered_stream(events: DataFrame, start: DataFrame, late: str = "1 hour", idle_ms: int = 7 * 24 * 3_600_000, navigate: bool = True) -> DataFrame:
    """A row of state for each tour whenever events of it have become due: ``events(tour_id, event_id, ts, action)``, up to ``late`` out of order.

    ``start(tour_id, stop_ids, statuses)`` is joined to the stream, so that a tour's first event brings its stops along.
    """
    timed = events.select("tour_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action").withWatermark("ts", late)
    joined = timed.join(start, "tour_id")
    return joined.groupBy("tour_id").transformWithStateInPandas(_Fold(navigate, idle_ms), STATE, "Update", "EventTime")
