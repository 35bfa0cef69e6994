"""Streams of keyed machines against their table form: several micro-batches, rows out of order, late rows, state that goes."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from barloom.streaming.drift import DriftMonitor, baseline_of, bin_counts, drift_report, features_of
from barloom.streaming.machines import SECOND, AlertPolicy, Exits, Signal, Watch, first_exits, signal_lives, watch_list

from .conftest import SMALL

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAR = int(datetime(2100, 1, 1, tzinfo=timezone.utc).timestamp()) * SECOND


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, tmp_path, job, parts):
    """Rows of a job in append mode, and the rows of state after the last batch."""
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(parts[0].schema).parquet(f"{tmp_path}/in")
    name = f"machine_{tmp_path.name}"
    query = job(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").start()
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query.processAllAvailable()
    query.stop()
    return sorted(map(str, spark.table(name).collect())), query.lastProgress


@pytest.fixture
def parts(rocks):
    """Events of few keys in three batches by time, shuffled inside; then a row far ahead and one too late."""
    events = rocks.read.parquet(f"{SMALL}/events.parquet").where("user_id < 5").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    edges = [datetime(2024, 1, 1), datetime(2024, 1, 9), datetime(2024, 1, 21), datetime(2024, 3, 1)]
    cut = [events.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))).orderBy(F.xxhash64("event_id")) for a, b in zip(edges, edges[1:], strict=False)]
    ahead = rocks.createDataFrame([(99, "end", datetime(2100, 1, 1), 10**6, 0.0)], "user_id long, event_type string, ts timestamp, event_id long, value double")
    late = rocks.createDataFrame([(0, "click", datetime(2024, 1, 2), 10**6 + 1, 99.0)], ahead.schema)
    return events, [*cut, ahead, late]


@pytest.mark.parametrize("name", ["lives", "watch"])
def test_stream_equals_table(rocks, tmp_path, parts, name):
    events, batches = parts
    job = {"lives": lambda e, **k: signal_lives(e, **k), "watch": lambda e, **k: watch_list(e, **k)}[name]
    got, progress = streamed(rocks, tmp_path, job, batches)
    want = sorted(map(str, job(events, until=FAR).collect()))
    assert got == want and len(want) > 20
    # Every signal has ended, so the state of all keys but the row far ahead is gone.
    assert progress["stateOperators"][0]["numRowsTotal"] <= 8


def test_exits_of_a_stream(rocks, tmp_path):
    day = lambda i: datetime(2024, 1, 1) + timedelta(days=i)
    prices = [100, 104, 112, 99, 88, 101, 101, 101, 130, 90]
    rows = [(s, day(i), 0, float(p)) for s in (1, 2) for i, p in enumerate(prices)]
    kind = "symbol long, ts timestamp, tie long, value double"
    parts = [rocks.createDataFrame([r for r in rows if lo <= (r[1] - day(0)).days < hi], kind) for lo, hi in ((0, 3), (3, 7), (7, 10))] + [rocks.createDataFrame([(9, datetime(2100, 1, 1), 0, 1.0)], kind)]
    got, _ = streamed(rocks, tmp_path, lambda e: first_exits(e, most=3), parts)
    assert got == sorted(map(str, first_exits(rocks.createDataFrame(rows, kind), most=3).collect()))


def test_a_signal_is_told_changed_muted_and_expires():
    policy = AlertPolicy(cooldown=100, change=10.0, most=2, validity=1000, grace=50, digest_below=1)
    s = Signal(policy)
    assert s.row(0, 50.0) == [(0, "CREATED", "SEND", "ACTIVE", 1)]
    assert s.row(10, 80.0)[0][2] == "MUTE_COOLDOWN" and s.row(200, 81.0)[0][2] == "MUTE_UNCHANGED"
    assert s.row(210, 95.0)[0][2:] == ("SEND", "ACTIVE", 2) and s.row(220, 120.0)[0][2] == "MUTE_DUPLICATE"
    assert s.due() == 220 + 1000 + 51 and s.lapse(1270) == [] and s.lapse(1271) == [(1220, "EXPIRED", None, "EXPIRED", 2)] and s.state is None
    assert s.row(2000, 10.0)[0][1:3] == ("CREATED", "SEND_DIGEST_ONLY") and s.row(2001, 1.0) == [(2001, "INVALIDATED", None, "INVALIDATED", 1)]
    assert s.row(2002, 1.0) == [] and s.row(2003, None)[0][1] == "CREATED"


def test_watch_and_exits_step_by_step():
    w = Watch(100, 2)
    assert w.row(0, 10.0) == [] and w.state is None and w.row(5, 75.0) == [] and w.row(50, 90.0) == []
    assert w.lapse(105) == [] and w.lapse(106) == [(5, 105, 2, 90.0)]
    x = Exits(0.1, -0.1, 2)
    assert x.row(1, 100.0) == [] and x.row(2, None) == [] and x.row(3, 111.0) == [(3, 1, "TARGET", 2)] and x.row(4, 90.0) == [(4, 2, "TIME", 2), (4, 3, "STOP", 1)]


def test_empty_and_null_rows(spark):
    kind = "user_id long, event_type string, ts timestamp, event_id long, value double"
    assert signal_lives(spark.createDataFrame([], kind), until=0).collect() == []
    assert signal_lives(spark.createDataFrame([(None, None, None, 1, 5.0)], kind)).collect() == []
    assert [r["event"] for r in signal_lives(spark.createDataFrame([(None, None, datetime(2024, 1, 1), None, None)], kind)).collect()] == ["CREATED"]


def test_drift_of_a_stream_counts_each_batch_once(rocks, tmp_path):
    events = rocks.read.parquet(f"{SMALL}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    rows = features_of(events)
    old = F.col("ts") < F.lit("2024-01-11").cast("timestamp")
    baseline = baseline_of(rows.where(old))
    monitor = DriftMonitor(rocks, f"{tmp_path}/counts", baseline)
    (tmp_path / "in").mkdir()
    query = monitor.start(features_of(rocks.readStream.schema(events.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/state")
    pieces = [events.where(~old & (F.pmod("event_id", F.lit(3)) == i)).drop("x") for i in range(3)]
    for piece in pieces:
        piece.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query.processAllAvailable()
    query.stop()
    monitor.add(features_of(pieces[1]), 1)  # the batch runs again
    want = drift_report(bin_counts(rows.where(~old), baseline.edges), baseline)
    keyed = lambda df: {(r["day"], r["feature"]): tuple(round(r[c], 9) for c in ("n", "psi", "ks", "mean_shift")) for r in df.collect()}
    assert keyed(monitor.report()) == keyed(want) and want.count() > 50
