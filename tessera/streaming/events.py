"""Structured Streaming operators over time-stamped events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream of files, its time as a timestamp."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    import os

    stream = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", name).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user that end after ``gap`` without an event: user_id, first_ts, last_ts, n."""
    gapped = F.session_window("ts", gap)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", gapped.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("user_id", "first_ts", "last_ts", "n")


def window_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their value per type in tumbling windows: event_type, start, n, total."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("event_type", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


def first_seen(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Events whose key has not come before within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def carried_forward(events: DataFrame, marks: str, most_rows: int, late: str = "1 day") -> DataFrame:
    """Per user the number of events that fall under a mark: user_id, carried, plain (running totals with each batch).

    An event of type ``marks`` sets the user's mark; it covers up to
    ``most_rows`` further events, then expires.  Events of a user are taken in
    order of time within a batch, batches as they come.  State is three numbers
    per user and goes after thirty days of event time without an event.
    """
    import pandas as pd

    def step(key, frames, state):
        left, carried, plain = state.get if state.exists else (0, 0, 0)
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            if kind == marks:
                left = most_rows
            elif left > 0:
                left, carried = left - 1, carried + 1
            else:
                plain += 1
        state.update((left, carried, plain))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + 30 * 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "carried": [carried], "plain": [plain]})

    rows = events.withWatermark("ts", late).select("user_id", "ts", "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, carried bigint, plain bigint", "remaining bigint, carried bigint, plain bigint", "update", "EventTimeTimeout")


def run_to_table(stream: DataFrame, path: str, mode: str, keys: Sequence[str] = ()) -> DataFrame:
    """Run a bounded stream to its end into tables at ``path``, and give what it found.

    Every micro-batch is a table of its own, written whole or written again
    after a failure; nothing passes the driver.  What counts is all batches of
    an ``append`` stream, the last of a ``complete`` one, and the latest row of
    each of ``keys`` of an ``update`` one.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/batches")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == last).drop("batch") if last is not None else rows.drop("batch")
    if mode == "update":
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "batch").alias("_r")).select(*keys, "_r.*")
    return rows.drop("batch")


def progress(stream: DataFrame, path: str, mode: str = "append") -> list[dict]:
    """Run a bounded stream to its end, dropping its rows, and give a frame per micro-batch: batch, rows, done."""
    query = stream.writeStream.foreachBatch(lambda rows, batch: rows.write.format("noop").mode("overwrite").save()).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    done, out = 0, []
    for p in query.recentProgress:
        done += p["numInputRows"] if isinstance(p, dict) else p.numInputRows
        out.append({"batch": p["batchId"] if isinstance(p, dict) else p.batchId, "rows": p["numInputRows"] if isinstance(p, dict) else p.numInputRows, "done": done})
    return out
