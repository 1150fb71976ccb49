"""Structured Streaming: watermarked windows, sessions, and sliding exposure state with same-time batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark, folder: str, files: int | None = None) -> DataFrame:
    """The events table of a folder as a stream of its files, with an event time that watermarks accept."""
    source = spark.readStream.schema(EVENT_SCHEMA)
    source = source.option("maxFilesPerTrigger", files) if files else source
    return source.option("pathGlobFilter", "events*.parquet").parquet(folder).withColumn("time", F.col("ts").cast("timestamp"))


def window_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, clicks and summed value of each tumbling window and type."""
    x = stream.withWatermark("time", late).groupBy(F.window("time", width), "event_type")
    return x.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user by inactivity."""
    x = stream.withWatermark("time", late).groupBy("user_id", F.session_window("time", gap))
    return x.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _sliding(width_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        out = []
        for ms, group in rows.groupby("ms"):
            held = [t for t in held if t > ms - width_ms]
            out += [(int(e), key[0], int(ms), len(held)) for e in group["event_id"]]
            held += [int(ms)] * len(group)
        state.update((held,))
        yield pd.DataFrame(out, columns=["event_id", "item_id", "ms", "n_before"])

    return step


def sliding_exposure(stream: DataFrame, width_ms: int) -> DataFrame:
    """For each event: exposures of its item in the open window before it; simultaneous ones don't see each other.

    State per item holds the times of the open window only. Input must arrive in time order by item.
    """
    x = stream.select("event_id", F.get_json_object("props", "$.k").alias("item_id"), F.unix_millis("time").alias("ms"))
    return x.groupBy("item_id").applyInPandasWithState(_sliding(width_ms), "event_id long, item_id string, ms long, n_before long", "held array<long>", "append", "NoTimeout")


def run_once(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its rows from a memory table."""
    name = f"q_{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", path) if path else writer
    q = writer.start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def windowed_counts(spark, sf_dir: str) -> DataFrame:
    """Hourly counts of the events stream in complete mode."""
    out = run_once(window_counts(event_stream(spark, sf_dir)), "complete")
    return out.select(F.unix_millis("start").alias("start_ms"), "event_type", "n", "value")
