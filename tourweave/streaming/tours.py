"""Status events of tours: one fold, replayed as a batch or kept as streaming state.

Events are ``(tour_id, event_id, ts, action)`` with actions ``done``, ``not_delivered``,
``later`` and ``reset``; others are ignored.  ``done`` and ``not_delivered`` mark the current
stop and move on to the next open one; ``later`` sends it to the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stages import cut

OPEN = ("pending", "later")
ACTIONS = ("done", "not_delivered", "later", "reset")
STATE = "tour_id long, stop_ids array<long>, statuses array<string>, current_index int, n_events long, n_navigations long"
COLUMNS = [field.split()[0] for field in STATE.split(", ")]


class Tour:
    """The state of one tour."""

    def __init__(self, ids: list, statuses: list[str], index: int = 0, events: int = 0, navigations: int = 0) -> None:
        self.ids, self.statuses, self.index, self.events, self.navigations = list(ids), list(statuses), index, events, navigations

    def next_open(self, start: int) -> int:
        """From ``start`` on, then from the front; -1 if no stop is open."""
        n = len(self.ids)
        return next((i for i in [*range(max(0, start), n), *range(min(max(0, start), n))] if self.statuses[i] in OPEN), -1)

    def apply(self, action: str, navigate: bool = True) -> None:
        if not self.ids or not 0 <= self.index < len(self.ids):
            return
        if action in ("done", "not_delivered"):
            self.events += 1
            self.statuses[self.index] = action
            target = self.next_open(self.index + 1)
            if target >= 0:
                self.index = target
                self.navigations += navigate
        elif action == "later":
            self.events += 1
            self.ids.append(self.ids.pop(self.index))
            self.statuses.pop(self.index)
            self.statuses.append("later")
            self.index = min(self.index, len(self.ids) - 1)
        elif action == "reset":
            self.events += 1
            self.statuses, self.index = ["pending"] * len(self.ids), 0

    def row(self, tour_id) -> tuple:
        return (tour_id, self.ids, self.statuses, self.index, self.events, self.navigations)


def _in_order(events: pd.DataFrame) -> pd.Series:
    return events.sort_values(["ts", "event_id"], kind="stable")["action"]


#: Events that one task holds at once, about.
CHUNK_ROWS = 1_000_000


def replay(stops: DataFrame, events: DataFrame, navigate: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The state of every tour after all its events; tours without stops are left out.

    A tour is one row, its stops and its known actions arrays in order; many tours are folded a batch.  Events beyond
    ``chunk_rows`` are dealt to ranges of tour, time and id, so that no task sorts or holds all events of a hot tour:
    a tour's ranges are folded one after the other, each from the state that the one before left, and only tours that go on take part in the next round.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tour_id, ids, statuses, index, n, navigations, actions in zip(*(b[c] for c in (*COLUMNS, "actions"))):
                tour = Tour(ids.tolist(), statuses.tolist(), int(index), int(n), int(navigations))
                for action in actions if actions is not None else ():
                    tour.apply(action, navigate)
                out.append(tour.row(tour_id))
            yield pd.DataFrame(out, columns=COLUMNS)

    def folded(state: DataFrame, told: DataFrame) -> DataFrame:
        actions = told.groupBy("tour_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "action"))).alias("e")).select("tour_id", F.col("e.action").alias("actions"))
        return state.join(actions, "tour_id", "left").mapInPandas(fold, STATE)

    mine = stops.groupBy("tour_id").agg(F.sort_array(F.collect_list(F.struct("pos", "stop_id", "status"))).alias("s"))
    state = mine.select("tour_id", F.col("s.stop_id").alias("stop_ids"), F.col("s.status").alias("statuses"), F.lit(0).alias("current_index"), F.lit(0).cast("long").alias("n_events"), F.lit(0).cast("long").alias("n_navigations"))
    known = events.where(F.col("action").isin(*ACTIONS)).select("tour_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "action")
    total = known.count()
    if total <= chunk_rows:
        return folded(state, known)
    known = cut(known.repartitionByRange(-(-total // chunk_rows), "tour_id", "ts", "event_id").withColumn("__part", F.spark_partition_id()))
    parts = known.groupBy("tour_id", "__part").count().withColumn("__chunk", F.row_number().over(Window.partitionBy("tour_id").orderBy("__part")))
    chunks = cut(parts.select("tour_id", "__part", "__chunk", F.max("__chunk").over(Window.partitionBy("tour_id")).alias("__last")))
    rounds = chunks.agg(F.max("__last")).first()[0] or 0
    lasts = chunks.groupBy("tour_id").agg(F.max("__last").alias("__last"))
    open_ = cut(state.join(lasts, "tour_id", "left"))
    done = open_.where("__last IS NULL").select(*COLUMNS)
    open_ = open_.where("__last IS NOT NULL")
    for number in range(1, rounds + 1):
        told = known.join(chunks.where(F.col("__chunk") == number).select("tour_id", "__part"), ["tour_id", "__part"], "left_semi")
        after = cut(folded(open_.select(*COLUMNS), told))
        done = done.unionByName(after.join(lasts.where(F.col("__last") == number), "tour_id", "left_semi"))
        open_ = after.join(lasts.where(F.col("__last") > number), "tour_id", "left_semi")
    return done


def last_status(events: DataFrame) -> DataFrame:
    """Per tour the latest action and how many there were: all that needs no fold."""
    known = events.where(F.col("action").isin("done", "not_delivered", "later"))
    return known.groupBy("tour_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("last_action"), F.count("*").alias("n_events"))


def stream(events: DataFrame, start: DataFrame, navigate: bool = True) -> DataFrame:
    """The same fold over an event stream: a row of state for each tour and micro-batch.

    ``start(tour_id, stop_ids, statuses)`` is joined to the stream, so that the first event of
    a tour brings its stops along; from then on they live in the state store.  Within a batch
    events are ordered by time and id; an event that comes in a later batch is applied later.
    """
    state = "ids array<long>, statuses array<string>, index int, events long, navigations long"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        told = pd.concat(list(batches))
        if kept.exists:
            tour = Tour(*kept.get)
        else:
            tour = Tour(told["stop_ids"].iloc[0], told["statuses"].iloc[0])
        for action in _in_order(told):
            tour.apply(action, navigate)
        _, *values = tour.row(key[0])
        ids, statuses, *counts = values  # the state takes plain Python values only
        kept.update(([int(i) for i in ids], [str(x) for x in statuses], *map(int, counts)))
        yield pd.DataFrame([tour.row(key[0])], columns=COLUMNS)

    joined = events.select("tour_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action").join(start, "tour_id")
    return joined.groupBy("tour_id").applyInPandasWithState(fold, STATE, state, "update", "NoTimeout")


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by action and window, for a batch or a stream; late ones up to the watermark count."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "action", "n")


def to_events(raw: DataFrame) -> DataFrame:
    """Events of a web log: purchases are deliveries, errors failed ones, views put off; others stay unknown."""
    action = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "not_delivered").when(F.col("event_type") == "view", "later").otherwise(F.col("event_type"))
    return raw.select(F.col("user_id").alias("tour_id"), "event_id", "ts", action.alias("action"))


def later_order(stops: DataFrame) -> DataFrame:
    """Positions with the stops put off behind the others: what ``later`` leads to when each is sent once."""
    order = Window.partitionBy("tour_id").orderBy(F.col("status") == "later", "pos")
    return stops.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
