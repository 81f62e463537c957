"""Streams with state of their own: duplicates within a horizon, and early rows of open sessions.

Both keep a small record per key in Spark's state store and let event-time timers close it. Rows of a key are taken in the order of
their time inside a micro-batch. Needs the RocksDB state store provider (``with_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """The rows of one key in one micro-batch."""
    return pd.concat(list(rows)).sort_values(by)


class Duplicates(StatefulProcessor):
    """First row of each content, and once its horizon is over how many rows there were; after that the content is new again."""

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "doc_id long, first long, copies long")

    def _closed(self, key, state) -> pd.DataFrame:
        return pd.DataFrame({"content_hash": [key[0]], "doc_id": [state[0]], "first_ms": [state[1]], "event": ["closed"], "copies": [state[2]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.seen.get() if self.seen.exists() else None
        for ms, doc_id in _in_order(rows, ["ms", "doc_id"])[["ms", "doc_id"]].itertuples(index=False):
            ms, doc_id = int(ms), int(doc_id)
            if state is not None and ms < state[1] + self.horizon:
                state = (state[0], state[1], state[2] + 1)
                continue
            if state is not None:
                self.handle.deleteTimer(state[1] + self.horizon)
                yield self._closed(key, state)
            state = (doc_id, ms, 1)
            self.handle.registerTimer(ms + self.horizon)
            yield pd.DataFrame({"content_hash": [key[0]], "doc_id": [doc_id], "first_ms": [ms], "event": ["first"], "copies": [1]})
        self.seen.update(state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            yield self._closed(key, self.seen.get())
            self.seen.clear()

    def close(self) -> None:
        pass


def duplicates(docs: DataFrame, horizon: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """(content_hash, doc_id, first_ms, event, copies) in append mode. Needs ``ts`` and ``doc_id``; rows later than ``late`` are dropped.

    ``event`` is 'first' for a content that was not seen within the horizon before, and 'closed', with the number of rows, when the
    horizon after its first row is over. A later row with the same content is a first one again.
    """
    horizon_ms = int(pd.Timedelta(horizon).total_seconds() * 1000)
    hashed = docs.select("ts", F.unix_millis("ts").alias("ms"), F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc_id"), T.content_hash(T.normalize_text(T.text_of("text"))).alias("content_hash"))
    return hashed.withWatermark("ts", late).groupBy("content_hash").transformWithStateInPandas(
        Duplicates(horizon_ms), "content_hash string, doc_id long, first_ms long, event string, copies long", "Append", "EventTime")


class Sessions(StatefulProcessor):
    """A row for a session whenever a micro-batch brings entries, and a last one when its gap is over."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, queries long, latency double")

    @staticmethod
    def _rows(key, states: list[tuple], events: list[str]) -> pd.DataFrame:
        first, last, n, total = zip(*states)
        return pd.DataFrame({"session_id": key[0], "start_ms": first, "last_ms": last, "queries": n, "avg_latency": [round(t / m, 6) for t, m in zip(total, n)], "event": events})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a call to the state store is a round trip, so timers move once a batch and not with every entry
        before = tuple(self.open.get()) if self.open.exists() else None
        state, closed, entries = before, [], _in_order(rows, ["ms"])
        for ms, latency in zip(entries["ms"].tolist(), entries["latency"].tolist()):
            if state is not None and ms >= state[1] + self.gap:
                closed.append(state)
                state = None
            if state is not None:
                state = (min(state[0], ms), max(state[1], ms), state[2] + 1, state[3] + latency)
            else:
                state = (ms, ms, 1, latency)
        if before is None or before[1] != state[1]:
            if before is not None:
                self.handle.deleteTimer(before[1] + self.gap)
            self.handle.registerTimer(state[1] + self.gap)
        self.open.update(state)
        yield self._rows(key, [*closed, state], ["closed"] * len(closed) + ["early"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield self._rows(key, [tuple(self.open.get())], ["closed"])
            self.open.clear()

    def close(self) -> None:
        pass


def early_sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(session_id, start_ms, last_ms, queries, avg_latency, event): 'early' rows of sessions that may go on, 'closed' rows of those that are over."""
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    rows = log.select("ts", F.unix_millis("ts").alias("ms"), "session_id", F.coalesce("latency", F.lit(0.0)).alias("latency"))
    return rows.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(
        Sessions(gap_ms), "session_id string, start_ms long, last_ms long, queries long, avg_latency double, event string", "Append", "EventTime")
