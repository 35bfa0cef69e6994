"""Streaming jobs over several micro-batches: state is carried from one to the next, late rows do not change what was told."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.streaming.jobs import activity_sessions, alerts, event_bars, event_stream

from .conftest import SMALL

PARTS = 4
END = "2100-01-01 00:00:00"


def in_parts(spark, tmp_path, job, parts):
    """Rows of a job in append mode, and the number of batches with rows in; a part arrives when the one before is done."""
    name = f"parts_{job.__name__}"
    query = job(event_stream(spark, f"{tmp_path}/in", parts[0].schema)).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").start()
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query.processAllAvailable()
    fed = sum(p.numInputRows > 0 for p in query.recentProgress)
    query.stop()
    return [tuple(r) for r in spark.table(name).collect()], fed


@pytest.mark.parametrize("job", [alerts, activity_sessions, event_bars])
def test_parts_give_what_the_table_gives(spark, tmp_path, job):
    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("value", F.col("value").cast("double"))
    edges = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.percentile("t", [i / PARTS for i in range(1, PARTS)])).first()[0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = [-(2**62), *edges, 2**62]
    parts = [events.where((at >= low) & (at < high)) for low, high in zip(bounds, bounds[1:], strict=False)]
    assert sum(p.count() for p in parts) == events.count()
    own = {f.name: f.dataType for f in events.schema}

    def row(user: int, kind: str, ts, value: float):
        return events.limit(1).select(*({"user_id": F.lit(user), "event_type": F.lit(kind), "ts": F.lit(ts), "value": F.lit(value)}.get(c, F.col(c)).cast(t).alias(c) for c, t in own.items()))

    last = row(-1, "end", END, 0.0)  # moves the watermark behind all other rows
    first = events.agg(F.min("ts").alias("t")).first()["t"]
    late = row(-2, "late", str(first), 0.0)
    got, fed = in_parts(spark, tmp_path, job, [*parts, last, late])
    want = [tuple(r) for r in job(events).collect()]
    assert fed >= PARTS  # alerts skip the two files without a value high enough
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > PARTS
