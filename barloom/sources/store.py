"""A store of bars as bucketed tables, and a log of records in folders by day."""

from __future__ import annotations

import zlib
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.sources.bars import BARS_SQL, bars

BUCKETS = 32
COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume", "vendor", "timeframe")


class BarStore:
    """Bars by (symbol, vendor, timeframe) in two tables, raw and adjusted. Each is bucketed by symbol and sorted by symbol
    and time inside a bucket, and each partition of vendor and timeframe holds one file for each bucket: windows by symbol
    and joins of both tables read it without an exchange (a join by symbol and time where the session has
    spark.sql.requireAllClusterKeysForCoPartition off, as both are dealt by symbol alone)."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    def table(self, adjusted: bool = False) -> str:
        return f"{self.name}_adjusted" if adjusted else self.name

    def write(self, rows: DataFrame, vendor: str, timeframe: str, adjusted: bool = False) -> int:
        """Replaces the bars of a vendor and timeframe. Of rows of one symbol and stamp the one with the largest volume
        stays (ties: the largest of the other columns); rows without a symbol or stamp are refused. Returns the bars."""
        if rows.where("symbol is null or ts is null").take(1):
            raise ValueError("a bar has a symbol and a stamp")
        values = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
        slim = rows.select(F.col("symbol").cast("string").alias("symbol"), F.col("ts").cast("date").alias("ts"), *values)
        best = slim.groupBy("symbol", "ts").agg(F.max(F.struct("volume", "close", "open", "high", "low")).alias("r")).select("symbol", "ts", "r.*")
        named = best.select(*COLUMNS[:-2], F.lit(vendor).alias("vendor"), F.lit(timeframe).alias("timeframe"))
        # One file for each bucket: rows are dealt as the table deals them.
        dealt = named.repartition(self.buckets, "symbol")
        there = self.spark.catalog.tableExists(self.table(adjusted))
        writer = dealt.write.mode("overwrite" if not there else "append")
        if there:
            self.spark.sql(f"ALTER TABLE {self.table(adjusted)} DROP IF EXISTS PARTITION (vendor = '{vendor}', timeframe = '{timeframe}')")
        writer.format("parquet").partitionBy("vendor", "timeframe").bucketBy(self.buckets, "symbol").sortBy("symbol", "ts").saveAsTable(self.table(adjusted))
        return self.read(vendor, timeframe, adjusted=adjusted).count()

    def read(self, vendor: str, timeframe: str, symbols: list[str] | None = None, first: str | None = None, last: str | None = None, adjusted: bool = False) -> DataFrame:
        """Bars of a vendor and timeframe; a list of symbols reads their buckets only."""
        rows = self.spark.table(self.table(adjusted)).where((F.col("vendor") == vendor) & (F.col("timeframe") == timeframe))
        if symbols is not None:
            rows = rows.where(F.col("symbol").isin(symbols))
        if first is not None:
            rows = rows.where(F.col("ts") >= F.lit(first).cast("date"))
        if last is not None:
            rows = rows.where(F.col("ts") <= F.lit(last).cast("date"))
        return rows.select(*COLUMNS)

    def symbols(self, vendor: str, timeframe: str, adjusted: bool = False) -> DataFrame:
        """Symbols with their first and last bar and the number of bars."""
        return self.read(vendor, timeframe, adjusted=adjusted).groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("bars"))

    def with_adjusted(self, vendor: str, timeframe: str) -> DataFrame:
        """Raw and adjusted close side by side."""
        raw = self.read(vendor, timeframe).select("symbol", "ts", "close")
        return raw.join(self.read(vendor, timeframe, adjusted=True).select("symbol", "ts", F.col("close").alias("adjusted_close")), ["symbol", "ts"])


class RecordLog:
    """Records appended as Parquet in a folder for each day."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, records: DataFrame, stamp: str) -> None:
        """Records without a stamp go to a day of their own, the oldest."""
        records.withColumn("day", F.coalesce(F.to_date(stamp), F.lit("0001-01-01").cast("date"))).write.mode("append").partitionBy("day").parquet(self.folder)

    def days(self) -> list[date]:
        """Days with records, newest first, by the names of the folders alone."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        return sorted((date.fromisoformat(n[4:]) for n in names if n.startswith("day=")), reverse=True)

    def latest(self, stamp: str, n: int, tie: str) -> DataFrame | None:
        """The n newest records, by stamp and then by `tie`, smallest last; None for a log without records. Days are opened
        from the newest on, twice as many each time, until they hold n records, so older ones are never read."""
        days, some = self.days(), 1
        while days:
            rows = self.spark.read.option("basePath", self.folder).parquet(*(f"{self.folder}/day={d.isoformat()}" for d in days[:some]))
            if some >= len(days) or rows.count() >= n:
                return rows.orderBy(F.desc(stamp), F.desc(tie)).limit(n).drop("day")
            some *= 2
        return None


def store_of(spark: SparkSession, sf_dir: str, name: str) -> BarStore:
    """The daily bars of a folder of tables in a store of their own, raw and with half their prices as the adjusted ones."""
    store = BarStore(spark, f"barloom_{name}_{zlib.crc32(sf_dir.encode()):08x}", 8)
    rows = bars(spark, sf_dir)
    store.write(rows, "trades", "1d")
    store.write(rows.withColumns({c: F.col(c) / 2 for c in ("open", "high", "low", "close")}), "trades", "1d", adjusted=True)
    return store


def s09_stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-bar means of raw closes beside the adjusted close, from the store."""
    rows = store_of(spark, sf_dir, "windows").with_adjusted("trades", "1d")
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-2, 0)
    return rows.select("symbol", "ts", "close", "adjusted_close", F.round(F.avg("close").over(w), 6).alias("mean_3"))


def s09_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_of(spark, sf_dir, "symbols").symbols("trades", "1d")


QUERIES = {f.__name__: f for f in (s09_stored_windows, s09_symbols)}
ORACLES = {
    "s09_stored_windows": f"SELECT symbol::VARCHAR AS symbol, ts, close, close / 2 AS adjusted_close, round(avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean_3 FROM ({BARS_SQL}) b",
    "s09_symbols": f'SELECT symbol::VARCHAR AS symbol, min(ts) AS "first", max(ts) AS "last", count(*) AS bars FROM ({BARS_SQL}) b GROUP BY symbol',
}
