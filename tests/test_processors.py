"""Streams with timers: over several triggers, with a restart and late events, they give what a plain replay gives."""

import datetime as dt

import pytest

from marketspark.streaming import processors as P

START = dt.datetime(2024, 1, 1)


def at(s):
    return START + dt.timedelta(seconds=s)


def run(spark, tmp_path, batches, schema, make, name):
    """The rows that come out when the batches arrive one by one, each in a run of its own from the checkpoint before it."""
    P.prepared(spark)
    source, sink, out = tmp_path / "in", tmp_path / "out", []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/{k}")
        stream = make(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source)))
        q = stream.writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(str(sink)).collect())


QUEUE = "event_id long, message_id long, ts timestamp, kind string"


def test_queue_retries_and_dead_letters(spark, tmp_path):
    """1: acknowledged; 2: two failures, then done; 3: never answered; 4: answers that count for nothing."""
    far = [(99, 9, at(100_000), "publish")]
    batches = [
        [(1, 1, at(0), "publish"), (2, 1, at(5), "ack"), (3, 2, at(0), "publish"), (4, 2, at(3), "nack"), (5, 3, at(0), "publish"), (6, 4, at(0), "ack")],
        [(7, 2, at(14), "nack"), (8, 4, at(20), "publish"), (9, 4, at(21), "publish"), (10, 2, at(40), "ack"), (11, 2, at(41), "nack"), (12, 4, at(30), "ack")],
        far,
        [(13, 1, at(10), "publish")],  # far behind the watermark
        [(100, 9, at(200_000), "nack")],
    ]
    got = run(spark, tmp_path, batches, QUEUE, P.queue, "queue")
    rows = [r for r in got if r[0] != 9]
    assert rows == sorted([
        (1, at(0), "delivered", 1), (1, at(5), "done", 1),
        (2, at(0), "delivered", 1), (2, at(3), "retry", 1), (2, at(13), "delivered", 2), (2, at(14), "retry", 2), (2, at(34), "delivered", 3), (2, at(40), "done", 3),
        (3, at(0), "delivered", 1), (3, at(60), "retry", 1), (3, at(70), "delivered", 2), (3, at(130), "retry", 2), (3, at(150), "delivered", 3), (3, at(210), "retry", 3), (3, at(250), "delivered", 4), (3, at(310), "dead", 4),
        (4, at(20), "delivered", 1), (4, at(30), "done", 1),
    ])


ALERTS = "event_id long, user_id long, ts timestamp, event_type string"


@pytest.mark.parametrize("cuts", [[7], [1, 2, 3, 4, 5, 6, 7], [3, 7]])
def test_alerts_resolve_or_expire(spark, tmp_path, cuts):
    """However the events are cut into runs."""
    rows = [(1, 1, at(0), "error"), (2, 1, at(10), "error"), (3, 1, at(20), "view"), (4, 2, at(30), "error"), (5, 2, at(40), "error"), (6, 1, at(50), "error"), (7, 3, at(500), "error")]
    batches = [rows[a:b] for a, b in zip([0, *cuts], cuts, strict=False)] + [[(98, 8, at(100_000), "view")], [(99, 8, at(200_000), "view")]]
    got = run(spark, tmp_path, batches, ALERTS, lambda s: P.alerts(s, 2, 300), "alerts")
    assert got == [(1, at(10), "ACTIVE"), (1, at(20), "RESOLVED"), (2, at(40), "ACTIVE"), (2, at(340), "EXPIRED")]
