"""Structured Streaming over the change events: windows, deduplication, sessions, state of last values, alerts, dead letters.
Each takes a streaming (or batch) DataFrame with event_id, ts (timestamp), user_id, event_type, value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "10 minutes"


def read(spark: SparkSession, path: str, glob: str = "events.parquet") -> DataFrame:
    """A file stream of event Parquet files with a declared schema; ts as an instant in the session's zone (UTC)."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", glob).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "6 hours", slide: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", LATE).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def alerts(events: DataFrame, width: str = "1 hour", rate: float = 0.2) -> DataFrame:
    """Windows whose share of error events passes `rate`."""
    g = events.withWatermark("ts", LATE).groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select(F.col("window.start").alias("start"), "n", "errors").where(F.col("errors") / F.col("n") > rate)


def enriched(events: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Stream-static join on key."""
    return events.join(dim, key, "left")


def dispatch(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], dead_letters: str, checkpoint: str):
    """Runs what is there: each type's rows go to its handler, rows of other types to a JSON dead-letter folder. The batch id
    names the dead letters' folder, so a batch that is run again overwrites its own."""

    def batch(df: DataFrame, number: int) -> None:
        for kind, f in handlers.items():
            f(df.where(F.col("event_type") == kind), number)
        df.where(~F.coalesce(F.col("event_type").isin(*handlers), F.lit(False))).write.mode("overwrite").json(f"{dead_letters}/batch={number}")

    q = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there into a memory table and returns it (small results: tests, dashboards)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
