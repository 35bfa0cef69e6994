"""Multiples of companies by quarter, where a multiple stands in its own history, ratios, and weights by several methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.sources.bars import BARS_SQL, bars
from barloom.sources.tables import RETURNS, STATEMENTS, derived

#: Quarterly accounts: the items that the orders do not have are fixed shares of those they have, and the market value is the
#: mean order of the quarter times a number of shares of the customer's own, so it moves and may be small.
ACCOUNTS = derived(
    "SELECT s.symbol, s.period, s.revenue, s.debt, s.revenue * 0.4 + s.profit * 0.2 AS gross, s.profit * 1.1 - s.revenue * 0.15 AS operating, s.profit * 1.4 - s.revenue * 0.2 AS ebitda, s.profit - s.revenue * 0.22 AS net_income, s.revenue * 0.5 + s.profit - s.debt * 0.9 AS equity, s.profit * 0.8 - s.debt * 0.1 - s.revenue * 0.1 AS free_cash, "
    "CASE WHEN s.profit > s.revenue * 0.22 THEN (s.profit - s.revenue * 0.22) * 0.3 END AS dividend, s.revenue / s.n_orders * (3 + s.symbol % 7) + 5000 AS market_value, s.revenue / s.n_orders * (3 + s.symbol % 7) + 5000 + s.debt - s.revenue * 0.1 AS enterprise_value FROM {statements} s",
    statements=STATEMENTS,
)
#: Metric: (numerator, denominator, whether a negative denominator makes it one to watch).
METRICS = {
    "PE": ("market_value", "net_income", True), "PB": ("market_value", "equity", True), "EV_EBITDA": ("enterprise_value", "ebitda", True), "EV_SALES": ("enterprise_value", "revenue", False), "PRICE_SALES": ("market_value", "revenue", False),
    "FCF_YIELD": ("free_cash", "market_value", False), "EARNINGS_YIELD": ("net_income", "market_value", False), "DIVIDEND_YIELD": ("dividend", "market_value", False),
}
YIELDS = ("FCF_YIELD", "EARNINGS_YIELD", "DIVIDEND_YIELD")
EPSILON, EXTREME, LEAST = 1e-9, 1000.0, 8


def _digits(value: Column, digits: int) -> Column:
    """Rounded as doubles are, scaled up and down: a decimal rounding takes a value that is already short (0.0324415) for a tie."""
    return F.round(value * 10.0**digits) / 10.0**digits


def multiples(accounts: DataFrame) -> DataFrame:
    """accounts(symbol, period, items) -> a row for each metric: numerator, denominator, value, status (INSUFFICIENT_DATA
    without both items, WATCH where the denominator is negative and the metric minds, ZERO where it is next to nothing, else
    OK) and extreme, an absolute value above EXTREME."""
    items = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(a).cast("double").alias("numerator"), F.col(b).cast("double").alias("denominator"), F.lit(minds).alias("minds")) for m, (a, b, minds) in METRICS.items()))
    rows = accounts.select("symbol", "period", F.inline(items))
    value = F.when(F.abs("denominator") >= EPSILON, _digits(F.col("numerator") / F.col("denominator"), 9))  # equal values are equal
    status = F.when(F.col("numerator").isNull() | F.col("denominator").isNull(), "INSUFFICIENT_DATA").when(F.col("minds") & (F.col("denominator") < 0), "WATCH").when(F.abs("denominator") < EPSILON, "ZERO").otherwise("OK")
    return rows.withColumns({"value": value, "status": status}).withColumn("extreme", F.coalesce(F.abs("value") > EXTREME, F.lit(False))).drop("minds")


def bands(found: DataFrame, least: int = LEAST) -> DataFrame:
    """multiples -> where the newest value of each symbol and metric stands among all its values: extremes, quartiles,
    mid-rank in per cent, z and status. Yields are turned round: a high one is cheap, and its rank counts from above. Fewer
    than `least` values are not judged; a negative newest value is one to watch."""
    own = Window.partitionBy("symbol", "metric")
    known = found.where("value is not null").withColumn("now", F.last("value").over(own.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    quartile = lambda p: F.percentile("value", F.lit(p))
    rank = 100 * (F.count_if(F.col("value") < F.col("now")) + 0.5 * F.count_if(F.col("value") == F.col("now"))) / F.count("*")
    z = F.when(F.count("*") >= 2, F.coalesce((F.first("now") - F.avg("value")) / F.nullif(F.stddev_samp("value"), F.lit(0.0)), F.lit(0.0)))
    rows = known.groupBy("symbol", "metric").agg(F.count("*").alias("n"), F.first("now").alias("now"), F.max("period").alias("as_of"), F.min("value").alias("low"), quartile(0.25).alias("p25"), quartile(0.5).alias("p50"), quartile(0.75).alias("p75"), F.max("value").alias("high"), rank.alias("rank"), z.alias("z"))
    turned = F.when(F.col("metric").isin(*YIELDS), 100 - F.col("rank")).otherwise(F.col("rank"))
    judged = F.when(F.col("n") < least, "INSUFFICIENT_DATA").when(F.col("now") < 0, "WATCH").when(F.col("rank") <= 10, "EXTREME_CHEAP").when(F.col("rank") <= 25, "CHEAP").when(F.col("rank") >= 90, "EXTREME_EXPENSIVE").when(F.col("rank") >= 75, "EXPENSIVE").otherwise("FAIR")
    return rows.withColumn("rank", turned).withColumn("status", judged)


def ratios(accounts: DataFrame) -> DataFrame:
    """Gross, operating, EBITDA and net margin, debt to equity; null on a zero denominator."""
    over = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return accounts.select("symbol", "period", over("gross", "revenue").alias("gross_margin"), over("operating", "revenue").alias("operating_margin"), over("ebitda", "revenue").alias("ebitda_margin"), over("net_income", "revenue").alias("net_margin"), over("debt", "equity").alias("debt_to_equity"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(_digits(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def a15_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(multiples(ACCOUNTS.frame(spark, sf_dir)).drop("numerator", "denominator"))


def a16_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bands(multiples(ACCOUNTS.frame(spark, sf_dir))))


def a19_five_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ratios(ACCOUNTS.frame(spark, sf_dir)))


METHODS = ("equal", "score", "confidence", "inverse_volatility", "risk_budget", "volatility_adjusted", "consensus", "hybrid")


def weights(rows: DataFrame, portfolio: str, target: float = 0.2) -> DataFrame:
    """rows(portfolio, score, confidence, sd, votes) -> eight weights that sum to one inside a portfolio (null where all raw
    ones are 0): equal; score and confidence, negative ones as 0; inverse volatility; risk budget (score over volatility);
    volatility adjusted (least of one and target over volatility); consensus (score times the share of agreeing votes); and
    hybrid, the mean of equal, score, confidence and inverse volatility. Sums are partial sums of a portfolio."""
    up = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    inverse = F.coalesce(F.try_divide(F.lit(1.0), F.when(F.col("sd") > 0, F.col("sd"))), F.lit(0.0))
    raw = {
        "equal": F.lit(1.0), "score": up(F.col("score")), "confidence": up(F.col("confidence")), "inverse_volatility": inverse, "risk_budget": up(F.col("score")) * inverse,
        "volatility_adjusted": F.least(F.lit(1.0), F.lit(target) * inverse), "consensus": up(F.col("score")) * up(F.col("votes")),
    }
    given = rows.withColumns({f"_{m}": c for m, c in raw.items()})
    sums = given.groupBy(F.col(portfolio).alias("_p")).agg(*(F.sum(f"_{m}").alias(f"_s_{m}") for m in raw))
    share = {m: F.try_divide(F.col(f"_{m}"), F.col(f"_s_{m}")) for m in raw}
    parts = [F.coalesce(share[m], F.lit(0.0)) for m in ("equal", "score", "confidence", "inverse_volatility")]
    joined = given.join(sums, F.col(portfolio).eqNullSafe(F.col("_p"))).withColumn("_hybrid", sum(parts[1:], parts[0]))
    whole = joined.groupBy(F.col("_p").alias("_q")).agg(F.sum("_hybrid").alias("_s_hybrid"))
    out = joined.join(whole, F.col("_p").eqNullSafe(F.col("_q")))
    return out.select(*(f"`{c}`" for c in rows.columns), *(share[m].alias(f"w_{m}") for m in raw), F.try_divide("_hybrid", "_s_hybrid").alias("w_hybrid"))


def b10_eight_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sector: the mean return is the score, the share of rising days the confidence."""
    r = RETURNS.frame(spark, sf_dir)
    rows = r.groupBy("sector", "symbol").agg((F.avg("r") - 0.3).alias("score"), (F.avg((F.col("r") > 0).cast("double")) - 0.4).alias("confidence"), F.stddev_samp("r").alias("sd"), F.avg((F.col("r") > 0.5).cast("double")).alias("votes"))
    found = weights(rows, "sector")
    return found.select("sector", "symbol", *(F.round(f"w_{m}", 9).alias(m) for m in METHODS))


def frame_quality(rows: DataFrame, keys: list[str], stamp: str, reference: Column, most_null: float = 0.05, stale_days: int = 30, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """A row for each column of a frame of features: null ratio, least and greatest value, whether it is constant, values out
    of its limits, days from the newest stamp with a value to `reference`, and a score of 100 less 20 for nulls above
    most_null, 10 for values out of limits, 10 for a constant and 5 for a stale column. One pass: each column is a set of
    aggregates, and distinct values are not gathered."""
    limits = limits or {}
    columns = [c for c in rows.columns if c not in (*keys, stamp)]
    figures = []
    for c in columns:
        low, high = limits.get(c, (None, None))
        value = F.col(f"`{c}`").try_cast("double") if dict(rows.dtypes)[c] != "double" else F.col(f"`{c}`")
        out = F.lit(False) if low is None else (value < low) | (value > high)
        figures.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(value.isNull()).alias("nulls"), F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(out).alias("outside"), F.max(F.when(value.isNotNull(), F.col(stamp))).alias("newest")))
    whole = rows.agg(F.array(*figures).alias("f")).select(F.inline("f"))
    share = F.coalesce(F.try_divide(F.col("nulls"), F.col("n")), F.lit(1.0))
    constant = F.coalesce(F.col("low") == F.col("high"), F.lit(True))
    days = F.datediff(reference, F.col("newest"))
    penalty = F.when(share > most_null, 20).otherwise(0) + F.when(F.col("outside") > 0, 10).otherwise(0) + F.when(constant, 10).otherwise(0) + F.when(F.coalesce(days > stale_days, F.lit(True)), 5).otherwise(0)
    return whole.select("column", "n", F.round(share, 6).alias("null_ratio"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "outside", constant.alias("is_constant"), days.alias("days_old"), (100 - penalty).alias("score"))


def a28_every_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of bars: returns over one day and twenty, an average of 200 days and a column without a value."""
    w = Window.partitionBy("symbol").orderBy("ts")
    ago = lambda n: F.try_divide("close", F.lag("close", n).over(w)) - 1
    rows = bars(spark, sf_dir).select("symbol", "ts", "close", "volume", ago(1).alias("ret_1"), ago(20).alias("ret_20"), F.when(F.row_number().over(w) >= 200, F.avg("close").over(w.rowsBetween(-199, 0))).alias("ma_200"), F.when(F.col("volume") < 0, F.col("close")).alias("never"), F.lit(1.0).alias("one"))
    return frame_quality(rows, ["symbol"], "ts", F.lit("1998-12-31").cast("date"), limits={"ret_1": (-0.99, 5.0), "volume": (0.0, 1e6)})


QUERIES = {f.__name__: f for f in (a15_multiples, a16_bands, a19_five_ratios, b10_eight_weights, a28_every_column)}

_ACC = f"acc AS MATERIALIZED ({ACCOUNTS.sql})"
_LONG = "m AS (" + " UNION ALL ".join(f"SELECT symbol, period, '{m}' AS metric, {a}::DOUBLE AS a, {b}::DOUBLE AS b, {minds} AS minds FROM acc" for m, (a, b, minds) in METRICS.items()) + f"), v AS (SELECT symbol, period, metric, CASE WHEN abs(b) >= {EPSILON} THEN round(a / b, 9) END AS value, CASE WHEN a IS NULL OR b IS NULL THEN 'INSUFFICIENT_DATA' WHEN minds AND b < 0 THEN 'WATCH' WHEN abs(b) < {EPSILON} THEN 'ZERO' ELSE 'OK' END AS status FROM m)"
_Q = lambda c, p: f"round(quantile_cont({c}, {p}), 6)"
ORACLES = {
    "a15_multiples": f"WITH {_ACC}, {_LONG} SELECT symbol, period, metric, round(value, 6) AS value, status, coalesce(abs(value) > {EXTREME}, FALSE) AS extreme FROM v",
    "a16_bands": f"""WITH {_ACC}, {_LONG}, h AS (SELECT symbol, metric, list(value ORDER BY period) AS l, max(period) AS as_of FROM v WHERE value IS NOT NULL GROUP BY symbol, metric),
g AS (SELECT *, l[len(l)] AS now, list_sort(l) AS s FROM h),
r AS (SELECT symbol, metric, len(l) AS n, now, as_of, s[1] AS low, list_aggregate(l, 'quantile_cont', 0.25) AS p25, list_aggregate(l, 'quantile_cont', 0.5) AS p50, list_aggregate(l, 'quantile_cont', 0.75) AS p75, s[len(s)] AS high,
  100 * (len(list_filter(l, lambda x: x < now)) + 0.5 * len(list_filter(l, lambda x: x = now))) / len(l) AS below, CASE WHEN len(l) >= 2 THEN coalesce((now - list_avg(l)) / nullif(list_stddev_samp(l), 0), 0) END AS z FROM g),
t AS (SELECT *, CASE WHEN metric LIKE '%YIELD' THEN 100 - below ELSE below END AS rank FROM r)
SELECT symbol, metric, n, round(now, 6) AS now, as_of, round(low, 6) AS low, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(high, 6) AS high, round(rank, 6) AS rank, round(z, 6) AS z,
  CASE WHEN n < {LEAST} THEN 'INSUFFICIENT_DATA' WHEN now < 0 THEN 'WATCH' WHEN rank <= 10 THEN 'EXTREME_CHEAP' WHEN rank <= 25 THEN 'CHEAP' WHEN rank >= 90 THEN 'EXTREME_EXPENSIVE' WHEN rank >= 75 THEN 'EXPENSIVE' ELSE 'FAIR' END AS status FROM t""",
    "a19_five_ratios": f"WITH {_ACC} SELECT symbol, period, round(gross / nullif(revenue, 0), 6) AS gross_margin, round(operating / nullif(revenue, 0), 6) AS operating_margin, round(ebitda / nullif(revenue, 0), 6) AS ebitda_margin, round(net_income / nullif(revenue, 0), 6) AS net_margin, round(debt / nullif(equity, 0), 6) AS debt_to_equity FROM acc",
    "b10_eight_weights": f"""WITH q AS (SELECT sector, symbol, greatest(avg(r) - 0.3, 0) AS score, greatest(avg((r > 0)::INT) - 0.4, 0) AS confidence, coalesce(1 / nullif(stddev_samp(r), 0), 0) AS inv, avg((r > 0.5)::INT) AS votes FROM ({RETURNS.sql}) x GROUP BY sector, symbol),
w AS (SELECT sector, symbol, 1 / count(*) OVER p AS equal, score / nullif(sum(score) OVER p, 0) AS score, confidence / nullif(sum(confidence) OVER p, 0) AS confidence, inv / nullif(sum(inv) OVER p, 0) AS inverse_volatility, score * inv / nullif(sum(score * inv) OVER p, 0) AS risk_budget, least(1, 0.2 * inv) / nullif(sum(least(1, 0.2 * inv)) OVER p, 0) AS volatility_adjusted, score * votes / nullif(sum(score * votes) OVER p, 0) AS consensus FROM q WINDOW p AS (PARTITION BY sector)),
h AS (SELECT *, equal + coalesce(score, 0) + coalesce(confidence, 0) + coalesce(inverse_volatility, 0) AS mix FROM w)
SELECT sector, symbol, {", ".join(f"round({m}, 9) AS {m}" for m in METHODS[:-1])}, round(mix / sum(mix) OVER (PARTITION BY sector), 9) AS hybrid FROM h""",
    "a28_every_column": f"""WITH f AS (SELECT symbol, ts, close, volume, close / nullif(lag(close) OVER w, 0) - 1 AS ret_1, close / nullif(lag(close, 20) OVER w, 0) - 1 AS ret_20, CASE WHEN row_number() OVER w >= 200 THEN avg(close) OVER (w ROWS 199 PRECEDING) END AS ma_200, NULL::DOUBLE AS never, 1.0 AS one FROM ({BARS_SQL}) b WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
u AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, ts, {c}::DOUBLE AS x, {low} AS low_limit, {high} AS high_limit FROM f" for c, low, high in (("close", "NULL", "NULL"), ("volume", "0", "1000000"), ("ret_1", "-0.99", "5"), ("ret_20", "NULL", "NULL"), ("ma_200", "NULL", "NULL"), ("never", "NULL", "NULL"), ("one", "NULL", "NULL")))}),
a AS (SELECT col, count(*) AS n, (count(*) - count(x)) / count(*) AS nulls, min(x) AS low, max(x) AS high, count(*) FILTER (x < low_limit OR x > high_limit) AS outside, count(DISTINCT x) <= 1 AS same, DATE '1998-12-31' - max(ts) FILTER (x IS NOT NULL) AS days FROM u GROUP BY col)
SELECT col AS "column", n, round(nulls, 6) AS null_ratio, round(low, 6) AS low, round(high, 6) AS high, outside, same AS is_constant, days AS days_old, 100 - CASE WHEN nulls > 0.05 THEN 20 ELSE 0 END - CASE WHEN outside > 0 THEN 10 ELSE 0 END - CASE WHEN same THEN 10 ELSE 0 END - CASE WHEN days IS NULL OR days > 30 THEN 5 ELSE 0 END AS score FROM a""",
}
