"""Small literal frames: ramps, flat prices, gaps, recursion, files, streams."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import alignment
from barloom.operators.indicators import INDICATORS
from barloom.operators.recursive import ewm, scan, supertrend_step
from barloom.plans.layers import Plan, Source
from barloom.plans.statements import Statement
from barloom.sources import files
from barloom.streaming.jobs import activity_sessions, alerts, event_bars, event_stream

from .conftest import SMALL

SCHEMA = "symbol long, ts date, open double, high double, low double, close double, volume double"


def bars(spark, closes: dict[int, list]):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([(s, day + dt.timedelta(i), c, None if c is None else c + 5, None if c is None else c - 5, c, 100.0) for s, own in closes.items() for i, c in enumerate(own)], SCHEMA)


def run(df, name):
    layers, out = INDICATORS[name]
    return Plan(Source(lambda s, d: df, ""), tuple(layers)).returning("symbol", "ts", *out).frame(df.sparkSession, "").orderBy("symbol", "ts").collect()


def test_ramp(spark):
    rows = run(bars(spark, {1: [float(i) for i in range(30)]}), "wn01_sma")
    assert [r["sma"] for r in rows[:3]] == [0.0, 0.5, 1.0] and rows[25]["sma"] == sum(range(6, 26)) / 20
    bands = run(bars(spark, {1: [float(i) for i in range(30)]}), "wn08_bb")
    assert bands[18]["bb_mid"] is None and bands[19]["bb_mid"] == 9.5 and bands[19]["bb_upper"] == pytest.approx(9.5 + 2 * pd.Series(range(20)).std(ddof=0))


@pytest.mark.parametrize("name", sorted(INDICATORS))
def test_flat_prices_are_no_error(spark, name):
    flat = bars(spark, {1: [10.0] * 30}).withColumns({"high": F.lit(10.0), "low": F.lit(10.0), "volume": F.lit(0.0)})
    assert len(run(flat, name)) == 30


def test_symbols_do_not_mix(spark):
    rows = run(bars(spark, {1: [1.0] * 5, 2: [9.0] * 5}), "wn01_sma")
    assert {r["sma"] for r in rows if r["symbol"] == 1} == {1.0} and {r["sma"] for r in rows if r["symbol"] == 2} == {9.0}


def test_smoothing_equals_pandas_over_gaps(spark):
    x = [None, 3.0, 4.0, None, None, 7.0, 1.0, None, 2.0]
    df = bars(spark, {1: x, 2: x[::-1]})
    got = ewm(df, {"y": ("close", 0.2, 2)}).orderBy("symbol", "ts").collect()
    for s, own in ((1, x), (2, x[::-1])):
        want = pd.Series(own, dtype=float).ewm(alpha=0.2, adjust=False, min_periods=2).mean()
        for a, b in zip([r["y"] for r in got if r["symbol"] == s], want, strict=True):
            assert (a is None and b != b) or a == pytest.approx(b)


def test_supertrend_turns(spark):
    prices = [100.0 + i for i in range(20)] + [110.0 - 3 * i for i in range(20)]
    df = bars(spark, {1: prices}).withColumn("atr", F.lit(2.0))
    rows = scan(df, ["high", "low", "close", "atr"], ["line", "direction"], lambda: (lambda step: lambda v: step(*v))(supertrend_step(3.0))).orderBy("ts").collect()
    assert rows[15]["direction"] == 1.0 and rows[-1]["direction"] == -1.0 and rows[-1]["line"] > rows[-1]["close"]


def test_files(spark, tmp_path):
    (tmp_path / "thyao.csv").write_text("ts,open,high,low,close,volume\n2024-01-02,1,2,0.5,1.5,10\n")
    rows = files.read_csv_bars(spark, str(tmp_path)).collect()
    assert rows[0]["symbol"] == "THYAO" and rows[0]["close"] == 1.5
    assert files.mapping_confidence(["Tarih", "open", "high", "low", "close", "volume"]) == 1.0
    numbers = spark.createDataFrame([("1.234,5",), ("1,234.5",), ("12",), ("x",), (None,)], "t string").select(files.number("t").alias("n")).collect()
    assert [r["n"] for r in numbers] == [1234.5, 1234.5, 12.0, None, None]
    files.append_records(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), f"{tmp_path}/records")
    assert files.latest_records(spark, f"{tmp_path}/records", "k long, v string", "k", 1).collect()[0]["v"] == "b"
    assert files.schema_drift(spark.range(1), {"id": "string", "x": "int"}) == {"missing": ["x"], "added": [], "changed": ["id"]}
    with pytest.raises(ValueError, match="no reader"):
        files.format_of("a.xyz")


def streamed(spark, df, tmp_path, job, mode):
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = job(event_stream(spark, f"{tmp_path}/in", df.schema))
    query = out.writeStream.outputMode(mode).format("memory").queryName(f"q_{job.__name__}").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    return {tuple(r) for r in spark.table(f"q_{job.__name__}").collect()}


@pytest.mark.parametrize("job", [event_bars, activity_sessions, alerts])
def test_stream_equals_table(spark, tmp_path, job):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    table = {tuple(r) for r in job(events).collect()}
    assert streamed(spark, events, tmp_path, job, "append" if job is alerts else "complete" if job is event_bars else "append") <= table
    if job is not activity_sessions:
        assert spark.table(f"q_{job.__name__}").count() == len(table)


@pytest.mark.parametrize(("statements", "name", "column", "want"), [(alignment.STATEMENTS, "t07_newest_by_fingerprint", "signal_id", 1_000_001), (alignment.STATEMENTS, "j04_status_as_of", "status", "P"), (alignment.STATEMENTS, "x03_lifecycle_state", "state", "P")])
def test_newest_record_over_a_million_ids(spark, statements, name, column, want):
    day = dt.date(1998, 5, 1)
    df = spark.createDataFrame([(999_999, 7, "A", "F", day), (1_000_001, 7, "A", "P", day), (1, 7, "A", "O", day)], "signal_id long, symbol long, strategy string, state string, ts date")
    rows = Statement(statements[name].text, {"outcomes": Source(lambda s, d: df, "")}).frame(spark, "").collect()
    assert [r[column] for r in rows] == [want]


def test_regime_filter_rejects(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, i), c, 100.0) for i, c in ((1, 70.0), (2, 90.0), (3, 110.0))], "symbol long, ts date, close double, ma_50 double")
    rows = Statement(alignment.STATEMENTS["e06_regime_filter"].text, {"breadth": Source(lambda s, d: df, "")}).frame(spark, "").orderBy("ts").collect()
    assert [r["decision"] for r in rows] == ["REJECT", "REDUCE", "PASS"]


def test_alerts_hold_no_whole_user(spark):
    """A user's events come in many batches; a table reads them in one sorted pass, without a group in memory."""
    events = spark.range(5000).selectExpr("id as event_id", "id % 2 as user_id", "timestamp_seconds(id * 977 % 5000 * 3600) as ts", "double(50 + id * 31 % 97) as value")
    rows = sorted((r["ts"], r["event_id"], r["user_id"], r["value"]) for r in events.collect())
    want, last = set(), {}
    for ts, _, user, value in rows:
        old = last.get(user)
        if old is None or ts - old[0] >= dt.timedelta(hours=12) or value - old[1] >= 30:
            want.add((user, ts, value, "FIRST" if old is None else "COOLDOWN_OVER" if ts - old[0] >= dt.timedelta(hours=12) else "CHANGE"))
            last[user] = (ts, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    out = alerts(events)
    got = [tuple(r) for r in out.collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == want and len(got) == len(want)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
