"""A quality report on bars: findings by symbol and check, with a severity, and a score; findings of imports and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.cleaning import FAULTY
from barloom.operators.trading_days import HOLIDAYS, trading_number
from barloom.sources.bars import BARS, BARS_SQL

PRICES = ("open", "high", "low", "close")
VALUES = (*PRICES, "volume")
SEVERITY = {"ERROR": 10, "WARNING": 2}
CAP = 20  #: best score of a symbol with a critical finding


def findings(rows: DataFrame, arrival: str | None = None, most_gap: int = 5, most_return: float = 0.5, least_rows: int = 30, holidays: list[str] = (), then: list[str] = ()) -> DataFrame:
    """rows(symbol, ts, open, high, low, close, volume) -> (symbol, check, severity, n), a row for each check that finds
    something: columns that are missing or no numbers (CRITICAL); rows out of order by `arrival`, repeated stamps, nulls and
    negative values by column, prices outside of high and low (ERROR); gaps of more than most_gap trading days, returns of
    more than most_return, a volume that is always 0, and fewer than least_rows rows (WARNING). A null price takes part in
    no relation. Rows of one stamp follow each other by the columns `then`, without which their order is open. An empty table has no symbol and so no finding."""
    types = dict(rows.dtypes)
    lacking = [c for c in VALUES if c not in types]
    text = [c for c in VALUES if c in types and types[c] in ("string", "boolean", "binary", "date", "timestamp")]
    there = [c for c in VALUES if c in types and c not in text]
    has = lambda *c: all(x in there for x in c)
    w, by_arrival = Window.partitionBy("symbol").orderBy("ts", *then), Window.partitionBy("symbol").orderBy(arrival) if arrival else None
    given = rows.withColumn("_gap", trading_number(F.col("ts"), list(holidays)) - trading_number(F.lag("ts").over(w), list(holidays)))
    if has("close"):
        given = given.withColumn("_move", F.abs(F.try_divide("close", F.lag("close").over(w)) - 1))
    if arrival:
        given = given.withColumn("_back", F.col("ts") < F.max("ts").over(by_arrival.rowsBetween(Window.unboundedPreceding, -1)))
    found: list[tuple[str, str, Column]] = [(f"missing_column_{c}", "CRITICAL", F.count("*")) for c in lacking] + [(f"not_numeric_{c}", "CRITICAL", F.count("*")) for c in text]
    if arrival:
        found.append(("unsorted", "ERROR", F.count_if("_back")))
    found.append(("repeated_stamp", "ERROR", F.count("ts") - F.count_distinct("ts")))
    found += [(f"null_{c}", "ERROR", F.count_if(F.col(c).isNull())) for c in there] + [(f"negative_{c}", "ERROR", F.count_if(F.col(c) < 0)) for c in there]
    relations = (("high", "<", "low"), ("high", "<", "open"), ("high", "<", "close"), ("low", ">", "open"), ("low", ">", "close"))
    found += [(f"{a}_{'below' if sign == '<' else 'above'}_{b}", "ERROR", F.count_if(F.col(a) < F.col(b) if sign == "<" else F.col(a) > F.col(b))) for a, sign, b in relations if has(a, b)]
    found.append(("large_gap", "WARNING", F.count_if(F.col("_gap") > most_gap)))
    if has("close"):
        found.append(("extreme_return", "WARNING", F.count_if(F.col("_move") > most_return)))
    if has("volume"):
        found.append(("zero_volume", "WARNING", F.when(F.count_if(F.coalesce(F.col("volume") != 0, F.lit(True))) == 0, F.count("*")).otherwise(0)))
    found.append(("few_rows", "WARNING", F.when(F.count("*") < least_rows, F.count("*")).otherwise(0)))
    counted = given.groupBy("symbol").agg(F.array(*(F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), n.cast("long").alias("n")) for name, severity, n in found)).alias("f"))
    return counted.select("symbol", F.inline("f")).where("n > 0")


def scores(rows: DataFrame, found: DataFrame) -> DataFrame:
    """By symbol: errors and warnings, and 100 less 10 for each error and 2 for each warning, CAP at most where something is
    critical, 0 at least."""
    each = found.groupBy("symbol").agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", *SEVERITY)))
    whole = rows.select("symbol").distinct().join(each, "symbol", "left").fillna(0, ["critical", "error", "warning"])
    plain = F.greatest(F.lit(0), 100 - 10 * F.col("error") - 2 * F.col("warning"))
    return whole.withColumn("score", F.when(F.col("critical") > 0, F.least(F.lit(CAP), plain)).otherwise(plain))


def import_findings(rows: DataFrame, key: list[str]) -> DataFrame:
    """(finding, n, share) of an imported table as a whole: rows, repeated rows (by a hash of all columns), repeated keys,
    rows without a key, and nulls and blanks by column. All in one pass but the two distinct counts."""
    n = F.count("*")
    row = F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in rows.columns))
    hashed = rows.withColumn("_row", row).withColumn("_key", F.when(F.greatest(*(F.col(k).isNull().cast("int") for k in key), F.lit(0)) == 0, F.xxhash64(*key)))
    figures = {"rows": n, "repeated_row": n - F.count_distinct("_row"), "repeated_key": F.count("_key") - F.count_distinct("_key"), "no_key": F.count_if(F.col("_key").isNull())}
    for c, t in rows.dtypes:
        figures[f"null_{c}"] = F.count_if(F.col(f"`{c}`").isNull())
        if t == "string":
            figures[f"blank_{c}"] = F.count_if(F.trim(F.col(f"`{c}`")) == "")
    whole = hashed.agg(F.array(*(F.struct(F.lit(k).alias("finding"), v.cast("long").alias("n")) for k, v in figures.items())).alias("f"), n.alias("all"))
    return whole.select("all", F.inline("f")).select("finding", "n", F.round(F.try_divide("n", "all"), 6).alias("share"))


def source_comparison(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Two sources of bars by symbol: stamps in both, in one only, without a close in one, the largest difference of the
    closes as a share of the first, and how many differ by more than `tolerance`."""
    joined = a.select("symbol", "ts", F.col("close").alias("a"), F.lit(1).alias("in_a")).join(b.select("symbol", "ts", F.col("close").alias("b"), F.lit(1).alias("in_b")), ["symbol", "ts"], "full")
    off = F.abs(F.try_divide(F.col("a") - F.col("b"), F.col("a")))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return joined.groupBy("symbol").agg(F.count_if(both).alias("in_both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(both & (F.col("a").isNull() | F.col("b").isNull())).alias("no_close"), F.round(F.max(off), 6).alias("worst"), F.count_if(off > tolerance).alias("off"))


def with_fallback(sources: list[DataFrame], valid: Column) -> DataFrame:
    """The bars of the first source that has a valid one for a symbol and stamp, with the number of the source (from 1)."""
    rows = None
    for k, source in enumerate(sources, 1):
        part = source.select("symbol", "ts", *VALUES, F.lit(k).alias("source")).where(valid)
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("symbol", "ts").agg(F.min_by(F.struct(*VALUES, "source"), "source").alias("r")).select("symbol", "ts", "r.*")


_HOLIDAYS = [f"{y}-{d}" for y in range(1995, 2002) for d in HOLIDAYS]
VALID = "close > 0 AND volume >= 0 AND high >= greatest(open, low, close) AND low <= least(open, close)"


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FAULTY.frame(spark, sf_dir)


def a26_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(_faulty(spark, sf_dir), most_gap=15, most_return=20.0, holidays=_HOLIDAYS, then=["place"])


def a26_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the faulty bars as they were typed: the volume is text."""
    rows = _faulty(spark, sf_dir).withColumn("volume", F.col("volume").cast("string"))
    return scores(rows, findings(rows, most_gap=15, most_return=20.0, holidays=_HOLIDAYS, then=["place"]))


def a29_table_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_findings(_faulty(spark, sf_dir).drop("place"), ["symbol", "ts"])


def j01_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars against the faulty ones, of which the later one of a stamp is compared, and against half of their days."""
    faulty = _faulty(spark, sf_dir).groupBy("symbol", "ts").agg(F.max_by("close", "place").alias("close")).where(F.pmod(F.dayofyear("ts"), F.lit(2)) == 0)
    return source_comparison(BARS.frame(spark, sf_dir).where(F.pmod(F.dayofyear("ts"), F.lit(3)) > 0), faulty)


def s13_second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty bars where they are valid, else the given ones."""
    first = _faulty(spark, sf_dir).where("place = 1")
    return with_fallback([first, BARS.frame(spark, sf_dir)], F.expr(VALID)).select("symbol", "ts", "close", "volume", "source")


QUERIES = {f.__name__: f for f in (a26_findings, a26_scores, a29_table_findings, j01_two_sources, s13_second_source)}
_DAYS = f"opened AS MATERIALIZED (SELECT d::DATE AS day, count(*) FILTER (isodow(d) <= 5 AND strftime(d, '%m-%d') NOT IN ({', '.join(repr(h) for h in HOLIDAYS)})) OVER (ORDER BY d) AS number FROM unnest(generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2002-12-31', INTERVAL 1 DAY)) u(d))"


def _checks_sql(volume: bool) -> str:
    """One statement for each check, over the bars in order of their stamps."""
    own = [c for c in VALUES if volume or c != "volume"]
    per = [(f"null_{c}", "ERROR", f"{c} IS NULL") for c in own] + [(f"negative_{c}", "ERROR", f"{c} < 0") for c in own]
    per += [("high_below_low", "ERROR", "high < low"), ("high_below_open", "ERROR", "high < open"), ("high_below_close", "ERROR", "high < close"), ("low_above_open", "ERROR", "low > open"), ("low_above_close", "ERROR", "low > close"), ("large_gap", "WARNING", "gap > 15"), ("extreme_return", "WARNING", "move > 20")]
    parts = [f"SELECT symbol, '{n}' AS \"check\", '{s}' AS severity, count(*) AS n FROM o WHERE {c} GROUP BY symbol" for n, s, c in per]
    parts.append("SELECT symbol, 'repeated_stamp', 'ERROR', count(*) - count(DISTINCT ts) FROM o GROUP BY symbol HAVING count(*) > count(DISTINCT ts)")
    parts.append("SELECT symbol, 'few_rows', 'WARNING', count(*) FROM o GROUP BY symbol HAVING count(*) < 30")
    if volume:
        parts.append("SELECT symbol, 'zero_volume', 'WARNING', count(*) FROM o GROUP BY symbol HAVING min(volume) = 0 AND max(volume) = 0 AND count(volume) = count(*)")
    else:
        parts.append("SELECT symbol, 'not_numeric_volume', 'CRITICAL', count(*) FROM o GROUP BY symbol")
    return f"WITH {_DAYS}, f AS ({FAULTY.sql}), o AS MATERIALIZED (SELECT f.*, number - lag(number) OVER w AS gap, abs(close / nullif(lag(close) OVER w, 0) - 1) AS move FROM f JOIN opened ON day = ts WINDOW w AS (PARTITION BY symbol ORDER BY ts, place)), c AS ({' UNION ALL '.join(parts)})"


_SAME = ", ".join(("symbol", "ts", *VALUES))
ORACLES = {
    "a26_findings": f"{_checks_sql(True)} SELECT * FROM c",
    "a26_scores": f"{_checks_sql(False)} SELECT symbol, critical, error, warning, CASE WHEN critical > 0 THEN least({CAP}, p) ELSE p END AS score FROM (SELECT symbol, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'ERROR') AS error, count(*) FILTER (severity = 'WARNING') AS warning, greatest(0, 100 - 10 * count(*) FILTER (severity = 'ERROR') - 2 * count(*) FILTER (severity = 'WARNING')) AS p FROM c GROUP BY symbol) q",
    "a29_table_findings": f"WITH f AS ({FAULTY.sql}), u AS (SELECT 'rows' AS finding, count(*) AS n FROM f UNION ALL SELECT 'repeated_row', count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_SAME} FROM f)) FROM f UNION ALL SELECT 'repeated_key', count(*) - (SELECT count(*) FROM (SELECT DISTINCT symbol, ts FROM f)) FROM f UNION ALL SELECT 'no_key', count(*) FILTER (symbol IS NULL OR ts IS NULL) FROM f"
    + "".join(f" UNION ALL SELECT 'null_{c}', count(*) - count({c}) FROM f" for c in ("symbol", "ts", *VALUES)) + ") SELECT finding, n, round(n / (SELECT count(*) FROM f), 6) AS share FROM u",
    "j01_two_sources": f"WITH a AS (SELECT * FROM ({BARS_SQL}) x WHERE dayofyear(ts) % 3 > 0), b AS (SELECT symbol, ts, arg_max_null(close, place) AS close FROM ({FAULTY.sql}) y WHERE dayofyear(ts) % 2 = 0 GROUP BY symbol, ts), j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, a.ts AS ta, b.ts AS tb, a.close AS x, b.close AS y, abs((a.close - b.close) / nullif(a.close, 0)) AS d FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts) SELECT symbol, count(ta) - count(*) FILTER (tb IS NULL) AS in_both, count(*) FILTER (tb IS NULL) AS only_a, count(*) FILTER (ta IS NULL) AS only_b, count(*) FILTER (ta IS NOT NULL AND tb IS NOT NULL AND (x IS NULL OR y IS NULL)) AS no_close, round(max(d), 6) AS worst, count(*) FILTER (d > 0.01) AS off FROM j GROUP BY symbol",
    "s13_second_source": f"WITH f AS (SELECT * FROM ({FAULTY.sql}) y WHERE place = 1 AND {VALID}) SELECT b.symbol, b.ts, coalesce(f.close, b.close) AS close, coalesce(f.volume, b.volume) AS volume, CASE WHEN f.symbol IS NULL THEN 2 ELSE 1 END AS source FROM ({BARS_SQL}) b LEFT JOIN f ON f.symbol = b.symbol AND f.ts = b.ts WHERE f.symbol IS NOT NULL OR (b.close > 0 AND b.volume >= 0)",
}
