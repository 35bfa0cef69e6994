"""A trading calendar by numbers: each day has the count of trading days up to it, so the next and the previous trading
day, the days between two dates and the day n ahead are differences of numbers or one equi-join on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.sources.bars import BARS_SQL, bars

# Holidays of every year, month and day.
HOLIDAYS = ("01-01", "04-23", "05-01", "05-19", "08-30", "10-29")


def _weekdays(day: Column) -> Column:
    """Monday to Friday among the days up to this one, counted from Monday, 5 January 1970."""
    n = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return F.floor(n / 7).cast("long") * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(4)) + 1


def trading_number(day: Column, holidays: list[str]) -> Column:
    """Trading days up to `day`, itself included: weekdays less the holidays among them. holidays: dates, a few for each
    year. The difference of two numbers is the number of trading days after the first, up to the second."""
    days = F.array(*(F.lit(h).cast("date") for h in sorted(set(holidays)))) if holidays else F.array().cast("array<date>")
    return _weekdays(day) - F.size(F.filter(days, lambda h: (h <= day) & (F.weekday(h) < 5)))


def trading_calendar(spark: SparkSession, first: str, last: str, holidays: list[str]) -> DataFrame:
    """A row for each day from first to last: day, kind (TRADING_DAY, WEEKEND, HOLIDAY), number."""
    days = spark.sql("SELECT explode(sequence(to_date(:a), to_date(:b))) AS day", args={"a": first, "b": last})
    listed = F.col("day").isin(*(F.lit(h).cast("date") for h in holidays)) if holidays else F.lit(False)
    kind = F.when(F.weekday("day") >= 5, "WEEKEND").when(listed, "HOLIDAY").otherwise("TRADING_DAY")
    return days.select("day", kind.alias("kind"), trading_number(F.col("day"), holidays).alias("number"))


def neighbours(rows: DataFrame, day: str, calendar: DataFrame, holidays: list[str]) -> DataFrame:
    """Adds kind, next_day and previous_day, the trading days around `day`: lookups of the day and of two numbers in the
    calendar, which must hold the days around. The calendar is a row for each day, so it is broadcast."""
    trading = calendar.where("kind = 'TRADING_DAY'")
    here = F.broadcast(calendar.select(F.col("day").alias("_day"), "kind"))
    ahead = F.broadcast(trading.select(F.col("day").alias("next_day"), F.col("number").alias("_next")))
    back = F.broadcast(trading.select(F.col("day").alias("previous_day"), F.col("number").alias("_previous")))
    numbered = rows.withColumn("_number", trading_number(F.col(day), holidays)).join(here, F.col(day) == F.col("_day"), "left")
    joined = numbered.join(ahead, F.col("_number") + 1 == F.col("_next"), "left").join(back, F.when(F.col("kind") == "TRADING_DAY", F.col("_number") - 1).otherwise(F.col("_number")) == F.col("_previous"), "left")
    return joined.drop("_day", "_number", "_next", "_previous")


def gaps(rows: DataFrame, holidays: list[str], least: int = 3) -> DataFrame:
    """rows(symbol, ts) -> stretches of more than `least` trading days without a row between two rows of a symbol: symbol,
    after, before, missing."""
    w = Window.partitionBy("symbol").orderBy("ts")
    missing = trading_number(F.col("ts"), holidays) - trading_number(F.col("after"), holidays)
    # A row on a closed day does not fill a trading day.
    inner = missing - F.when((F.weekday("ts") < 5) & ~F.date_format("ts", "yyyy-MM-dd").isin(*holidays), 1).otherwise(0)
    return rows.select("symbol", F.col("ts").cast("date").alias("ts")).withColumn("after", F.lag("ts").over(w)).where("after is not null").withColumn("missing", inner.cast("long")).where(F.col("missing") > least).select("symbol", "after", F.col("ts").alias("before"), "missing")


def _span(frame: DataFrame) -> tuple[str, str, list[str]]:
    """First and last day with room around, and the holidays of these years."""
    low, high = frame.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return "1970-01-01", "1970-01-01", []
    return f"{low.year - 1}-12-01", f"{high.year + 1}-01-31", [f"{y}-{d}" for y in range(low.year - 1, high.year + 2) for d in HOLIDAYS]


def r05_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar with the kind of its day, the trading days around it and those since the symbol's bar before."""
    rows = bars(spark, sf_dir).select("symbol", "ts")
    first, last, holidays = _span(rows)
    w = Window.partitionBy("symbol").orderBy("ts")
    since = trading_number(F.col("ts"), holidays) - trading_number(F.lag("ts").over(w), holidays)
    return neighbours(rows.withColumn("trading_days_since", since), "ts", trading_calendar(spark, first, last, holidays), holidays)


def r01_trading_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars named by the last trading day of their week, which is not Friday where that is a holiday."""
    rows = bars(spark, sf_dir)
    _, _, holidays = _span(rows)
    week = F.date_trunc("week", "ts").cast("date")
    friday = F.date_add(week, 4)
    end = F.coalesce(*(F.when(~F.date_format(F.date_sub(friday, i), "yyyy-MM-dd").isin(*holidays), F.date_sub(friday, i)) for i in range(5)), friday) if holidays else friday
    weekly = rows.groupBy("symbol", end.alias("period")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return weekly


def s12_gap_list(spark: SparkSession, sf_dir: str, least: int = 20) -> DataFrame:
    rows = bars(spark, sf_dir)
    return gaps(rows, _span(rows)[2], least)


def s12_refresh_from(spark: SparkSession, sf_dir: str, reference: str = "1998-12-01", near: int = 5, stale: int = 60) -> DataFrame:
    """What to fetch for each symbol on the reference day, by trading days since its newest bar: SKIP within `near`,
    FROM_LAST (the five days before its newest bar on) within `stale`, else FULL."""
    rows = bars(spark, sf_dir).where(F.col("ts") <= F.lit(reference).cast("date"))
    holidays = _span(rows)[2]
    newest = rows.groupBy("symbol").agg(F.max("ts").alias("newest"))
    behind = trading_number(F.lit(reference).cast("date"), holidays) - trading_number(F.col("newest"), holidays)
    plan = F.when(F.col("behind") <= near, "SKIP").when(F.col("behind") <= stale, "FROM_LAST").otherwise("FULL")
    return newest.withColumn("behind", behind).withColumn("plan", plan).withColumn("from_day", F.when(F.col("plan") == "FROM_LAST", F.date_sub("newest", 5)))


QUERIES = {f.__name__: f for f in (r05_trading_days, r01_trading_weeks, s12_gap_list, s12_refresh_from)}
#: The calendar as a list of days, searched by comparison.
_DAYS = f"""b AS MATERIALIZED ({BARS_SQL}), span AS (SELECT min(year(ts)) - 1 AS a, max(year(ts)) + 1 AS z FROM b),
days AS MATERIALIZED (SELECT d::DATE AS day, CASE WHEN isodow(d) > 5 THEN 'WEEKEND' WHEN strftime(d, '%m-%d') IN ({", ".join(f"'{h}'" for h in HOLIDAYS)}) THEN 'HOLIDAY' ELSE 'TRADING_DAY' END AS kind FROM span, unnest(generate_series(make_date(a::INT, 12, 1)::TIMESTAMP, make_date(z::INT, 1, 31)::TIMESTAMP, INTERVAL 1 DAY)) u(d)),
open_days AS MATERIALIZED (SELECT day FROM days WHERE kind = 'TRADING_DAY'),
seen AS MATERIALIZED (SELECT day, kind, (SELECT count(*) FROM open_days o WHERE o.day <= d.day) AS number, (SELECT min(day) FROM open_days o WHERE o.day > d.day) AS next_day, (SELECT max(day) FROM open_days o WHERE o.day < d.day) AS previous_day FROM days d)"""
ORACLES = {
    "r05_trading_days": f"WITH {_DAYS} SELECT symbol, ts, kind, next_day, previous_day, number - lag(number) OVER (PARTITION BY symbol ORDER BY ts) AS trading_days_since FROM b JOIN seen ON seen.day = b.ts",
    "r01_trading_weeks": f"WITH {_DAYS}, ends AS (SELECT date_trunc('week', day)::DATE AS week, max(day) AS period FROM open_days GROUP BY 1) SELECT symbol, coalesce(period, date_trunc('week', ts)::DATE + 4) AS period, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by(close, ts) AS close, sum(volume) AS volume FROM b LEFT JOIN ends ON ends.week = date_trunc('week', ts)::DATE GROUP BY 1, 2",
    "s12_gap_list": f"WITH {_DAYS}, g AS (SELECT symbol, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS after, ts AS before FROM b), n AS (SELECT g.*, y.number - x.number - CASE WHEN y.kind = 'TRADING_DAY' THEN 1 ELSE 0 END AS missing FROM g JOIN seen x ON x.day = g.after JOIN seen y ON y.day = g.before) SELECT * FROM n WHERE missing > 20",
    "s12_refresh_from": f"WITH {_DAYS}, m AS (SELECT symbol, max(ts) AS newest FROM b WHERE ts <= DATE '1998-12-01' GROUP BY symbol), n AS (SELECT m.*, (SELECT count(*) FROM open_days o WHERE o.day > m.newest AND o.day <= DATE '1998-12-01') AS behind FROM m) SELECT symbol, newest, behind, CASE WHEN behind <= 5 THEN 'SKIP' WHEN behind <= 60 THEN 'FROM_LAST' ELSE 'FULL' END AS plan, CASE WHEN behind > 5 AND behind <= 60 THEN newest - 5 END AS from_day FROM n",
}
