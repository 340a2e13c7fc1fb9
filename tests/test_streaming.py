"""Streams over what is there give the batch answer."""

import json
import os

import pytest
from pyspark.sql import functions as F

from marketspark.streaming import events as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", ["tumbling", "sliding", "alerts"])
def test_stream_equals_batch(spark, tmp_path, name):
    f = getattr(E, name)
    stream = E.drain(f(E.read(spark, SF)), f"mem_{name}", str(tmp_path / "c"))
    batch = f(spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert key(stream.collect()) == key(batch.collect())


def test_dedup_and_dispatch(spark, tmp_path):
    seen = E.drain(E.deduplicated(E.read(spark, SF), ["user_id", "event_type"]), "mem_dedup", str(tmp_path / "d"), "append")
    assert seen.count() == spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type").distinct().count()
    counts = {}
    E.dispatch(E.read(spark, SF), {"error": lambda df, n: counts.__setitem__("error", df.count()), "click": lambda df, n: counts.__setitem__("click", df.count())}, str(tmp_path / "dead"), str(tmp_path / "x"))
    e = spark.read.parquet(f"{SF}/events.parquet")
    dead = [json.loads(line) for p in (tmp_path / "dead").rglob("part-*.json") for line in p.read_text().splitlines()]
    assert counts == {k: e.where(F.col("event_type") == k).count() for k in ("error", "click")} and len(dead) == e.count() - sum(counts.values())


def test_keyed_state(spark, tmp_path):
    from marketspark.plans.catalog import QUERIES
    from marketspark.streaming import state as Z

    got = E.drain(Z.changes(E.read(spark, SF)), "mem_changes", str(tmp_path / "s"), "append").collect()
    want = QUERIES["change_state"](spark, SF).collect()
    assert sorted((r.event_id, r.kind, r.before or "") for r in got) == sorted((r.event_id, r.kind, r.before or "") for r in want)
    rows = sorted((r.user_id, r.ts, r.event_id, r.event_type) for r in spark.read.parquet(f"{SF}/events.parquet").collect())
    tokens, at, allowed, run, active, alerts = {}, {}, {}, {}, {}, []
    for u, ts, i, kind in rows:
        t = min(2.0, tokens.get(u, 2.0) + ((ts - at[u]).total_seconds() if u in at else 0) / 86400)
        allowed[i] = t >= 1
        tokens[u], at[u] = t - allowed[i], ts
        run[u] = run.get(u, 0) + 1 if kind == "error" else 0
        if run[u] >= 2 and not active.get(u):
            active[u] = True
            alerts.append((i, "ACTIVE"))
        elif run[u] == 0 and active.get(u):
            active[u] = False
            alerts.append((i, "RESOLVED"))
    bucket = E.drain(Z.token_bucket(E.read(spark, SF), 1 / 86400, 2.0), "mem_bucket", str(tmp_path / "b"), "append").collect()
    assert {r.event_id: r.allowed for r in bucket} == allowed and not all(allowed.values())
    fired = E.drain(Z.alert_lifecycle(E.read(spark, SF), 2), "mem_alerts2", str(tmp_path / "a"), "append").collect()
    assert sorted((r.event_id, r.status) for r in fired) == sorted(alerts) and alerts
