"""Exact percentiles of a whole column, found in a narrow range of values around an estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.clusters import kept
from barloom.sources.tables import RETURNS

ACCURACY = 10_000  #: the estimate is off by 1 / ACCURACY of the rows at most


def percentiles(rows: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row with a column for each share (0 to 1): the value at share * (n - 1) of the sorted values, between two of them
    in proportion; null without values. An estimate brackets the place by 3 / ACCURACY of the rows on each side; the values
    inside are counted, equal ones as one, those below only as a number, so a task holds a small fixed share of the distinct
    values. rows are read twice."""
    known = rows.select(F.col(column).cast("double").alias("v")).where("v is not null")
    margin = 3 / ACCURACY
    ends = [e for s in shares.values() for e in (max(s - margin, 0.0), min(s + margin, 1.0))]
    sketch = known.agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, ends)), ACCURACY).alias("e"), F.min("v").alias("least"), F.max("v").alias("most"))
    low = lambda k: F.when(F.lit(ends[2 * k] == 0.0), F.col("least")).otherwise(F.col("e")[2 * k])
    high = lambda k: F.when(F.lit(ends[2 * k + 1] == 1.0), F.col("most")).otherwise(F.col("e")[2 * k + 1])
    v, nothing = F.col("v"), F.lit(None).cast("double")
    mark = lambda k: F.struct(F.lit(k).alias("k"), F.when((v >= low(k)) & (v <= high(k)), v).alias("at"), F.when(v < low(k), v).otherwise(nothing).alias("under"), F.when(v > high(k), v).otherwise(nothing).alias("over"))
    marked = known.join(F.broadcast(sketch)).select("n", F.inline(F.array(*map(mark, range(len(shares))))))
    counted = marked.groupBy("k", "at", "n").agg(F.count_if(F.col("over").isNull()).alias("c"), F.max("under").alias("under"), F.min("over").alias("over"))
    # Places count from 0. Those below the range stand first; of a short column the place may be next to the range.
    upto = F.sum("c").over(Window.partitionBy("k").orderBy(F.asc_nulls_first("at")).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.element_at(F.array(*map(F.lit, shares.values())), F.col("k") + 1) * (F.col("n") - 1)
    value = lambda place: F.coalesce(F.max(F.when(F.col("at").isNull() & (F.col("upto") > place), F.col("under"))), F.min(F.when(F.col("upto") > place, F.col("at"))), F.max("over"))
    found = counted.withColumn("upto", upto).groupBy("k").agg(value(F.floor(rank)).alias("a"), value(F.ceil(rank)).alias("b"), F.first(rank - F.floor(rank)).alias("part"))
    exact = F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part"))
    return found.agg(*(F.max(F.when(F.col("k") == k, exact)).alias(name) for k, name in enumerate(shares)))


def winsorised(rows: DataFrame, column: str, limits: DataFrame) -> DataFrame:
    """rows with the column held between low and high of limits (one row); null stays null."""
    held = F.when(F.col(column).isNotNull(), F.least(F.greatest(column, "low"), F.col("high")))
    return rows.join(F.broadcast(limits)).withColumn(column, held).drop("low", "high")


def m03_winsorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the percentiles 1 and 99 of the training part."""
    rows = kept(RETURNS.frame(spark, sf_dir).select("symbol", "ts", "r"))
    limits = percentiles(rows.where("ts < DATE '1999-01-01'"), "r", {"low": 0.01, "high": 0.99})
    return winsorised(rows, "r", limits).select("symbol", "ts", F.round("r", 6).alias("r"))


QUERIES = {"m03_winsorised": m03_winsorised}
#: The statement in `tabular.py` is its check.
ORACLES: dict[str, str] = {}
