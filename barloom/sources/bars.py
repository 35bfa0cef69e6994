"""Daily bars from trades: one row for each symbol and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.layers import Source


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


PART_BYTES = 4 << 20  #: of a table's files, some 350,000 trades, whose rows one task sorts


def parts(spark: SparkSession, sf_dir: str, table: str = "lineitem") -> int:
    """Partitions that grow with a table, so that a task's rows do not: by Spark's estimate of its size, and as many as the
    session shuffles into at least."""
    size = int(read(spark, sf_dir, table)._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, open, high, low, close, volume: the supplier is the symbol, a line item a trade, and the
    price is in whole cents. A trade's place in
    its day is its order and line number; one shuffle by symbol, which serves the windows of a symbol, too."""
    trades = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("ts"), F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("double").alias("price"),
        F.col("l_quantity").alias("quantity"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("place"),
    )
    return trades.repartition(parts(spark, sf_dir), "symbol").groupBy("symbol", "ts").agg(
        F.min_by("price", "place").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "place").alias("close"), F.sum("quantity").alias("volume")
    )


BARS_SQL = """SELECT symbol, ts, min_by(price, place) AS open, max(price) AS high, min(price) AS low, max_by(price, place) AS close, sum(quantity) AS volume
FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts, CAST(floor(l_extendedprice * 100 / l_quantity) AS DOUBLE) AS price, l_quantity AS quantity, l_orderkey * 100 + l_linenumber AS place FROM lineitem) GROUP BY symbol, ts"""

BARS = Source(bars, BARS_SQL)
