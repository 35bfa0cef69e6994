"""Folds for validation: each row goes to its own folds by arithmetic on its day, so nothing is joined or multiplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.tables import RETURNS


def _offset(rows: DataFrame, day: str) -> tuple[DataFrame, int, int]:
    """rows with x, the days since the first one, and the first and last day as numbers."""
    number = F.datediff(F.col(day).cast("date"), F.lit("1970-01-01").cast("date"))
    low, high = rows.agg(F.min(number), F.max(number)).first()
    return rows.withColumn("_x", number - F.lit(low or 0)), low or 0, high or 0


def walk_forward(rows: DataFrame, day: str, train: int, test: int, step: int, purge: int = 0, embargo: int = 0, anchored: bool = False) -> DataFrame:
    """Adds fold (from 1) and part, a row for each fold that a row belongs to. Fold k trains on `train` days from the first
    day + (k - 1) * step (anchored: from the first day on) and tests on the `test` days after them, as long as those lie
    before the last day. The last `purge` days of the training part and the first `embargo` days of the test go to neither.
    Rows without a day are in no fold; an empty table gives none."""
    if min(train, test, step) < 1 or not 0 <= purge < train or not 0 <= embargo < test:
        raise ValueError("windows and step are at least a day, purge and embargo shorter than their windows")
    placed, low, high = _offset(rows, day)
    folds = max(0, (high - low - train - test) // step + 1)
    x = F.col("_x")

    def those(first: Column, last: Column, part: str) -> Column:
        """Folds first..last, within 0..folds - 1."""
        a, z = F.greatest(first, F.lit(0)), F.least(last, F.lit(folds - 1))
        return F.when(a <= z, F.transform(F.sequence(a, z), lambda k: F.struct((k + 1).cast("int").alias("fold"), F.lit(part).alias("part")))).otherwise(F.array().cast("array<struct<fold: int, part: string>>"))

    up = lambda c: F.ceil(c / step).cast("long")
    down = lambda c: F.floor(c / step).cast("long")
    # Training: k * step <= x < k * step + train - purge; an anchored one has no lower end.
    trained = those(up(x - (train - purge) + 1), F.lit(folds - 1) if anchored else down(x), "train")
    tested = those(up(x - (train + test) + 1), down(x - train - embargo), "test")
    return placed.where(x.isNotNull()).withColumn("_in", F.explode(F.concat(trained, tested))).select(*(f"`{c}`" for c in rows.columns), "_in.fold", "_in.part")


def purged_folds(rows: DataFrame, day: str, folds: int, purge: int, embargo: int) -> DataFrame:
    """Adds fold (from 1) and part: the days are cut into `folds` runs of equal length (the last takes the rest), each a
    test part once. All other rows train, but the `purge` days on either side of the test, and on the later side
    `embargo` days more."""
    if folds < 2 or purge < 0 or embargo < 0:
        raise ValueError("at least two folds, and no negative days")
    placed, low, high = _offset(rows, day)
    size = max(1, (high - low) // folds)
    x, own = F.col("_x"), F.least(F.floor(F.col("_x") / size), F.lit(folds - 1)).cast("long")
    start = lambda k: k * size
    end = lambda k: F.when(k == folds - 1, F.lit(high - low)).otherwise(k * size + size - 1)
    part = lambda k: F.when(k == own, "test").when((x < start(k) - purge) | (x > end(k) + purge + embargo), "train")
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long")), lambda k: F.struct((k + 1).cast("int").alias("fold"), part(k).alias("part")))
    return placed.where(x.isNotNull()).withColumn("_in", F.explode(F.filter(every, lambda f: f["part"].isNotNull()))).select(*(f"`{c}`" for c in rows.columns), "_in.fold", "_in.part")


def overlapping(folded: DataFrame, day: str) -> DataFrame:
    """Folds with a day that both trains and tests: none where the folds are right."""
    return folded.groupBy("fold", day).agg(F.count_distinct("part").alias("parts")).where("parts > 1").groupBy("fold").agg(F.count("*").alias("days"))


TRAIN, TEST, STEP, PURGE, EMBARGO, FOLDS = 700, 120, 300, 10, 5, 4


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RETURNS.frame(spark, sf_dir).select("symbol", "ts")


def m05_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk_forward(_rows(spark, sf_dir), "ts", TRAIN, TEST, STEP, PURGE, EMBARGO)


def m05_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk_forward(_rows(spark, sf_dir), "ts", TRAIN, TEST, STEP, PURGE, EMBARGO, True)


def m05_purged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purged_folds(_rows(spark, sf_dir), "ts", FOLDS, PURGE, EMBARGO)


QUERIES = {f.__name__: f for f in (m05_walk_forward, m05_anchored, m05_purged_rows)}
#: Folds as a table of dates, joined by range.
_BASE = f"r AS MATERIALIZED (SELECT symbol, ts FROM ({RETURNS.sql}) x), s AS (SELECT min(ts) AS a, max(ts) AS z FROM r)"


def _walk_sql(anchored: bool) -> str:
    start = "a" if anchored else f"a + (k * {STEP})::INT"
    folds = f"f AS (SELECT (k + 1)::INT AS fold, {start} AS train_start, a + (k * {STEP} + {TRAIN} - {PURGE})::INT AS train_end, a + (k * {STEP} + {TRAIN} + {EMBARGO})::INT AS test_start, a + (k * {STEP} + {TRAIN} + {TEST})::INT AS test_end FROM s, range(1000) t(k) WHERE a + (k * {STEP} + {TRAIN} + {TEST})::INT <= z)"
    return f"WITH {_BASE}, {folds} SELECT symbol, ts, fold, CASE WHEN ts < train_end THEN 'train' ELSE 'test' END AS part FROM r JOIN f ON (ts >= train_start AND ts < train_end) OR (ts >= test_start AND ts < test_end)"


ORACLES = {
    "m05_walk_forward": _walk_sql(False),
    "m05_anchored": _walk_sql(True),
    "m05_purged_rows": f"WITH {_BASE}, n AS (SELECT a, z, (z - a) // {FOLDS} AS size FROM s), f AS (SELECT (k + 1)::INT AS fold, a + (k * size)::INT AS lo, CASE WHEN k = {FOLDS - 1} THEN z ELSE a + (k * size + size - 1)::INT END AS hi FROM n, range({FOLDS}) t(k)) SELECT symbol, ts, fold, CASE WHEN ts BETWEEN lo AND hi THEN 'test' ELSE 'train' END AS part FROM r JOIN f ON ts BETWEEN lo AND hi OR ts < lo - {PURGE} OR ts > hi + {PURGE + EMBARGO}",
}
