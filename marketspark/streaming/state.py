"""Keyed state over event streams: change detection and token buckets. Events need event_id, ts, user_id, event_type."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")


def changes(events: DataFrame) -> DataFrame:
    """user_id, event_id, kind, before: an event whose type differs from the key's event before it (null for the first). State
    is the last type; within a trigger events are taken in order of time."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for r in _ordered(frames).itertuples():
            if r.event_type != last:
                out.append((key[0], r.event_id, r.event_type, last))
            last = r.event_type
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "kind", "before"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, kind string, before string", "last string", "append", GroupStateTimeout.NoTimeout)


def token_bucket(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """user_id, event_id, allowed: an event takes a token of its key's bucket, which fills by `rate` a second up to `burst`."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (burst, None)
        out = []
        for r in _ordered(frames).itertuples():
            now = r.ts.timestamp()
            if at is not None:
                tokens = min(burst, tokens + max(0.0, now - at) * rate)
            at, allowed = now if at is None else max(at, now), tokens >= 1
            tokens -= allowed
            out.append((key[0], r.event_id, bool(allowed)))
        state.update((float(tokens), float(at)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)


def alert_lifecycle(counts: DataFrame, limit: int) -> DataFrame:
    """user_id, event_id, status: ACTIVE when a key's count of errors in a row reaches the limit, RESOLVED at the next other
    event; nothing in between, so an alert fires once."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, active = state.get if state.exists else (0, False)
        out = []
        for r in _ordered(frames).itertuples():
            n = n + 1 if r.event_type == "error" else 0
            if n >= limit and not active:
                active = True
                out.append((key[0], r.event_id, "ACTIVE"))
            elif n == 0 and active:
                active = False
                out.append((key[0], r.event_id, "RESOLVED"))
        state.update((int(n), bool(active)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "status"])

    return counts.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, status string", "n int, active boolean", "append", GroupStateTimeout.NoTimeout)
