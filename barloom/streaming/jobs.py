"""Structured Streaming jobs over the events table, each with a batch twin that tests compare it with."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATENESS = "1 hour"
RUN_ROWS = 1000  #: rows of a piece of a sorted run, and of alerts that are given on at once


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def _timed(events: DataFrame) -> DataFrame:
    """A stream gets a watermark, which needs stamps with a time zone; a table stays as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS) if events.isStreaming else events


def event_bars(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Bars of the values of each event type; works on a stream (late rows beyond LATENESS are dropped) and on a table."""
    place = F.struct("ts", "event_id")
    bars = _timed(events).groupBy("event_type", F.window("ts", width).alias("w")).agg(F.min_by("value", place).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", place).alias("close"), F.count("*").alias("n"))
    return bars.select("event_type", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def activity_sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Runs of a user's events without a gap as long as `gap`."""
    runs = _timed(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return runs.select("user_id", F.col("w.start").alias("start"), "n", "top")


ALERT_OUT = "user_id long, ts timestamp, value double, reason string"
ALERT_STATE = "last_alert timestamp, last_value double"


class Decider:
    """Alerts of one user in time order: outside the cooldown, or inside it if the value grew by `change`. Stamps and the
    cooldown are in microseconds; without a stamp a row is in no cooldown that ended."""

    def __init__(self, cooldown: int, change: float, last: tuple[int | None, float] | None = None):
        self.cooldown, self.change, self.last = cooldown, change, last

    def reason(self, ts: int | None, value: float) -> str | None:
        over = self.last is not None and None not in (ts, self.last[0]) and ts - self.last[0] >= self.cooldown
        if self.last is not None and not over and not value - self.last[1] >= self.change:
            return None
        found = "FIRST" if self.last is None else "COOLDOWN_OVER" if over else "CHANGE"
        self.last = (ts, value)
        return found


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, float]]:
    """(stamp, value) of all rows of a key by stamp and event: each batch is sorted and written, then all are merged, so
    one piece of each is in memory."""

    def rows(path: str):
        with pa.OSFile(path) as source:
            for batch in pa.ipc.open_stream(source):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    with tempfile.TemporaryDirectory() as folder:
        runs = []
        for frame in batches:
            table = pa.table({"ts": pa.array(frame["ts"]).cast(pa.timestamp("us")).cast(pa.int64()), "event_id": pa.array(frame["event_id"]), "value": pa.array(frame["value"])})
            runs.append(f"{folder}/{len(runs)}")
            with pa.OSFile(runs[-1], "wb") as sink, pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table.sort_by([("ts", "ascending"), ("event_id", "ascending")]), max_chunksize=RUN_ROWS)
        for ts, _, value in heapq.merge(*map(rows, runs), key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            yield ts, value


def alerts(events: DataFrame, least: float = 50.0, cooldown: str = "12 hours", change: float = 30.0) -> DataFrame:
    """Alert decisions for values of at least `least`. On a stream the last alert of a user is kept as state; on a table
    one sorted pass carries it from row to row, so a task holds one batch however many events a user has."""
    wait, hot = pd.Timedelta(cooldown) // pd.Timedelta("1us"), events.where(F.col("value") >= least).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")

    def frame(user, out) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [user] * len(out), "ts": pd.to_datetime([t for t, _, _ in out], unit="us"), "value": [v for _, v, _ in out], "reason": [r for _, _, r in out]})

    def stream(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        decider, out = Decider(wait, change, last and (None if last[0] is None else pd.Timestamp(last[0]).value // 1000, last[1])), []
        for ts, value in _in_order(batches):
            if reason := decider.reason(ts, value):
                out.append((ts, value, reason))
            if len(out) >= RUN_ROWS:
                yield frame(key[0], out)
                out = []
        if decider.last is not None:
            state.update((None if decider.last[0] is None else pd.Timestamp(decider.last[0], unit="us").to_pydatetime(), float(decider.last[1])))
        yield frame(key[0], out)

    def table(batches):
        user, decider = object(), None
        for batch in batches:
            kept, reasons = [], []
            stamps = batch.column("ts").cast(pa.int64()).to_pylist()
            for i, (key, ts, value) in enumerate(zip(batch.column("user_id").to_pylist(), stamps, batch.column("value").to_pylist(), strict=True)):
                if decider is None or key != user:
                    user, decider = key, Decider(wait, change)
                if reason := decider.reason(ts, value):
                    kept.append(i)
                    reasons.append(reason)
            found = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([found.column("user_id"), found.column("ts"), found.column("value"), pa.array(reasons, pa.string())], ["user_id", "ts", "value", "reason"])

    if hot.isStreaming:
        return hot.groupBy("user_id").applyInPandasWithState(stream, ALERT_OUT, ALERT_STATE, "append", GroupStateTimeout.NoTimeout)
    rows = hot.select(F.col("user_id").cast("long").alias("user_id"), "ts", F.col("value").cast("double").alias("value"), "event_id")
    return rows.repartition("user_id").sortWithinPartitions("user_id", F.asc_nulls_last("ts"), "event_id").mapInArrow(table, ALERT_OUT)
