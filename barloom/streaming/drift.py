"""Drift by day from mergeable bin counts: a stream adds the counts of each micro-batch, a report reads their sums."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

EPSILON, BINS = 0.0001, 10
HIGH, MODERATE = 0.25, 0.1


@dataclass(frozen=True)
class Baseline:
    """counts(feature, bin, n, total) and edges(feature, low, high) of the reference rows; a row for each feature and bin, so
    both are small: features times `bins`."""

    counts: DataFrame
    edges: DataFrame
    bins: int = BINS


def _bin(low: Column, high: Column, bins: int) -> Column:
    """Equal bins from low to high; values outside fall into the first and the last one, as do all where low is high."""
    place = F.floor((F.col("value") - low) / F.nullif(high - low, F.lit(0.0)) * bins)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(place, F.lit(0)))).cast("int")


def bin_counts(rows: DataFrame, edges: DataFrame, bins: int = BINS) -> DataFrame:
    """rows(feature, ts, value) -> (day, feature, bin, n, total), summed before the shuffle. Null values and stamps, and
    features without edges, are left out. Counts of two tables are those of both together when they are added."""
    known = rows.where("value is not null and ts is not null").join(F.broadcast(edges), "feature")
    return known.groupBy(F.to_date("ts").alias("day"), "feature", _bin(F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def baseline_of(rows: DataFrame, bins: int = BINS) -> Baseline:
    edges = rows.where("value is not null").groupBy("feature").agg(F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high"))
    counts = bin_counts(rows, edges, bins).groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return Baseline(counts, edges, bins)


def drift_report(counts: DataFrame, baseline: Baseline) -> DataFrame:
    """By day and feature, from sums of bin_counts: psi (shares with EPSILON added, then scaled to one), ks (the largest gap
    of the shares up to a bin), mean_shift, n and class."""
    merged = counts.groupBy("day", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    sizes = merged.groupBy("day", "feature").agg(F.sum("n").alias("days_n"), F.sum("total").alias("days_total"))
    grid = sizes.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(baseline.bins - 1))))
    reference = baseline.counts.select("feature", "bin", F.col("n").alias("ref_n"))
    ref_sizes = baseline.counts.groupBy("feature").agg(F.sum("n").alias("ref_size"), F.sum("total").alias("ref_total"))
    rows = grid.join(merged.drop("total"), ["day", "feature", "bin"], "left").join(F.broadcast(reference), ["feature", "bin"], "left").join(F.broadcast(ref_sizes), "feature")
    share = lambda n, size: F.coalesce(F.col(n), F.lit(0)) / F.col(size)
    one = 1 + EPSILON * baseline.bins
    shares = rows.withColumns({"a": share("ref_n", "ref_size"), "c": share("n", "days_n")})
    order = Window.partitionBy("day", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ra, rc = (F.col("a") + EPSILON) / one, (F.col("c") + EPSILON) / one
    gap = F.abs(F.sum("a").over(order) - F.sum("c").over(order))
    judged = shares.withColumns({"part": (rc - ra) * F.ln(rc / ra), "gap": gap})
    found = judged.groupBy("day", "feature").agg(F.first("days_n").alias("n"), F.sum("part").alias("psi"), F.max("gap").alias("ks"), (F.first("days_total") / F.first("days_n") - F.first("ref_total") / F.first("ref_size")).alias("mean_shift"))
    return found.withColumn("class", F.when(F.col("psi") > HIGH, "HIGH").when(F.col("psi") > MODERATE, "MODERATE").otherwise("LOW"))


class DriftMonitor:
    """Counts of a stream in a folder, a subfolder for each micro-batch. A batch that runs again replaces its own counts, so
    none is counted twice; late rows are counted in their own day, whenever they come."""

    def __init__(self, spark: SparkSession, folder: str, baseline: Baseline):
        self.spark, self.folder, self.baseline = spark, folder.rstrip("/"), baseline

    def add(self, rows: DataFrame, batch: int) -> None:
        bin_counts(rows, self.baseline.edges, self.baseline.bins).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def start(self, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = rows.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def report(self) -> DataFrame:
        return drift_report(self.spark.read.parquet(self.folder), self.baseline)


def features_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("feature"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))


def x08_drift_monitor(spark: SparkSession, sf_dir: str, until: str = "2024-01-11") -> DataFrame:
    """Values of each event type by day against the days before `until`."""
    rows = features_of(spark.read.parquet(f"{sf_dir}/events.parquet"))
    old = F.col("ts") < F.lit(until).cast("timestamp")
    baseline = baseline_of(rows.where(old))
    found = drift_report(bin_counts(rows.where(~old), baseline.edges), baseline)
    return found.select("day", "feature", "n", F.round("psi", 6).alias("psi"), F.round("ks", 6).alias("ks"), F.round("mean_shift", 6).alias("mean_shift"), "class")


ORACLE = f"""WITH e AS (SELECT event_type AS feature, ts, value FROM events WHERE value IS NOT NULL), o AS (SELECT * FROM e WHERE ts < '2024-01-11'), s AS (SELECT * FROM e WHERE ts >= '2024-01-11'),
lim AS (SELECT feature, min(value) AS low, max(value) AS high, count(*) AS size, avg(value) AS mean FROM o GROUP BY feature),
bins AS (SELECT unnest(range({BINS})) AS bin),
place AS (SELECT x.*, CAST(greatest(0, least({BINS - 1}, coalesce(floor((value - low) / nullif(high - low, 0) * {BINS}), 0))) AS INT) AS bin FROM (SELECT *, NULL::DATE AS day FROM o UNION ALL SELECT *, ts::DATE FROM s) x JOIN lim USING (feature)),
d AS (SELECT day, feature, count(*) AS n, avg(value) AS mean FROM place WHERE day IS NOT NULL GROUP BY day, feature),
q AS (SELECT d.day, d.feature, d.n, d.mean - lim.mean AS shift, bin, (SELECT count(*) FROM place p WHERE p.day IS NULL AND p.feature = d.feature AND p.bin = bins.bin) / size AS a, (SELECT count(*) FROM place p WHERE p.day = d.day AND p.feature = d.feature AND p.bin = bins.bin) / d.n AS c FROM d JOIN lim USING (feature), bins),
w AS (SELECT *, (a + {EPSILON}) / (sum(a + {EPSILON}) OVER g) AS ra, (c + {EPSILON}) / (sum(c + {EPSILON}) OVER g) AS rc, abs(sum(a) OVER (g ORDER BY bin) - sum(c) OVER (g ORDER BY bin)) AS gap FROM q WINDOW g AS (PARTITION BY day, feature)),
f AS (SELECT day, feature, any_value(n) AS n, sum((rc - ra) * ln(rc / ra)) AS psi, max(gap) AS ks, any_value(shift) AS shift FROM w GROUP BY day, feature)
SELECT day, feature, n, round(psi, 6) AS psi, round(ks, 6) AS ks, round(shift, 6) AS mean_shift, CASE WHEN psi > {HIGH} THEN 'HIGH' WHEN psi > {MODERATE} THEN 'MODERATE' ELSE 'LOW' END AS class FROM f"""
