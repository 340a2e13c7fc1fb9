"""Keyed state with timers and expiry: a queue's retries with back-off and dead letters, and alerts that resolve by silence.

Both run by event time. What is due at a time is done before any later event of its key, whether a timer or the event comes
first, so that results don't depend on how a stream is cut into triggers. State lives in RocksDB (see prepared())."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marketspark.streaming.events import LATE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the state store that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _ms(t: Any) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


def _at(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class _Due(StatefulProcessor):
    """Events of a key in order of time, with one deadline at most. Subclasses have STATE (DDL of what is kept besides the
    deadline), start(), event() and due(), which return (state or None, deadline or None, rows)."""

    STATE: str
    COLUMNS: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"{self.STATE}, deadline long")

    def _load(self) -> tuple[tuple | None, int | None]:
        if not self.kept.exists():
            return None, None
        *state, deadline = self.kept.get()
        return tuple(state), deadline

    def _save(self, state: tuple | None, before: int | None, deadline: int | None) -> None:
        if before is not None and before != deadline:
            self.handle.deleteTimer(before)
        if deadline is not None and before != deadline:
            self.handle.registerTimer(deadline)
        if state is None:
            self.kept.clear()
        else:
            self.kept.update((*state, deadline))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        state, deadline = self._load()
        before, out = deadline, []
        for r in frame.itertuples():
            now = _ms(r.ts)
            while deadline is not None and deadline < now:
                at = deadline
                state, deadline, more = self.due(key[0], state, at)
                out += more
            state, deadline, more = self.event(key[0], state, deadline, r, now)
            out += more
        self._save(state, before, deadline)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state, deadline = self._load()
        before, out = deadline, []
        # What follows within the watermark is due as well.
        while deadline is not None and deadline <= timerValues.getCurrentWatermarkInMs():
            state, deadline, more = self.due(key[0], state, deadline)
            out += more
        if before is not None and before != deadline:
            self._save(state, None, deadline)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


class _Queue(_Due):
    """State: attempts so far, and whether the message waits for an answer."""

    STATE, COLUMNS = "attempt int, waiting boolean", ["message_id", "ts", "status", "attempt"]

    def __init__(self, retries: int, wait_ms: int, backoff_ms: int):
        self.retries, self.wait, self.backoff = retries, wait_ms, backoff_ms

    def failed(self, key, attempt: int, at: int) -> tuple:
        if attempt > self.retries:
            return None, None, [(key, _at(at), "dead", attempt)]
        return (attempt, False), at + self.backoff * 2 ** (attempt - 1), [(key, _at(at), "retry", attempt)]

    def due(self, key, state, at: int) -> tuple:
        attempt, waiting = state
        if waiting:  # no answer in time
            return self.failed(key, attempt, at)
        return (attempt + 1, True), at + self.wait, [(key, _at(at), "delivered", attempt + 1)]

    def event(self, key, state, deadline, r, now: int) -> tuple:
        if r.kind == "publish" and state is None:
            return (1, True), now + self.wait, [(key, _at(now), "delivered", 1)]
        if state is None or not state[1] or r.kind not in ("ack", "nack"):
            return state, deadline, []
        if r.kind == "ack":
            return None, None, [(key, _at(now), "done", state[0])]
        return self.failed(key, state[0], now)


def queue(events: DataFrame, retries: int = 3, wait: int = 60, backoff: int = 10) -> DataFrame:
    """message_id, ts, status, attempt: what happens to the messages of a queue.

    events: event_id, message_id, ts, kind (publish, ack, nack). A published message is delivered; an ack ends it (done); a
    nack, or `wait` seconds without an answer, has it delivered again after `backoff` seconds, twice as long each time; after
    `retries` such rounds it is dead. Answers to messages that wait for none don't count; a message that has ended may be
    published again."""
    return events.withWatermark("ts", LATE).groupBy("message_id").transformWithStateInPandas(
        statefulProcessor=_Queue(retries, wait * 1000, backoff * 1000), outputStructType="message_id long, ts timestamp, status string, attempt int", outputMode="Append", timeMode="EventTime"
    )


class _Alerts(_Due):
    """State: errors in a row, and whether the alert is active."""

    STATE, COLUMNS = "n int, active boolean", ["user_id", "ts", "status"]

    def __init__(self, limit: int, quiet_ms: int):
        self.limit, self.quiet = limit, quiet_ms

    def due(self, key, state, at: int) -> tuple:
        return None, None, [(key, _at(at), "EXPIRED")] if state[1] else []

    def event(self, key, state, deadline, r, now: int) -> tuple:
        n, active = state or (0, False)
        n = n + 1 if r.event_type == "error" else 0
        out = []
        if n >= self.limit and not active:
            active = True
            out.append((key, _at(now), "ACTIVE"))
        elif n == 0 and active:
            active = False
            out.append((key, _at(now), "RESOLVED"))
        return ((n, active), now + self.quiet, out) if n or active else (None, None, out)


def alerts(events: DataFrame, limit: int, quiet: int) -> DataFrame:
    """user_id, ts, status: ACTIVE when a key's errors in a row reach the limit, RESOLVED at its next other event, EXPIRED
    after `quiet` seconds without events. Keys without errors in a row keep no state. events: event_id, user_id, ts, event_type."""
    return events.withWatermark("ts", LATE).groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_Alerts(limit, quiet * 1000), outputStructType="user_id long, ts timestamp, status string", outputMode="Append", timeMode="EventTime"
    )
