"""Policies with all their choices: missing values, price adjustment, scan rules and ranking, dates, collections, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.trades import _SIGNALS_SQL, scored_signals
from barloom.sources.bars import BARS_SQL, bars, read
from barloom.sources.tables import POSITIONS, RETURNS

POLICIES = ("DROP", "FFILL", "BFILL", "INTERPOLATE", "LEAVE", "FAIL")


def fill_missing(rows: DataFrame, column: str, policy: str) -> DataFrame:
    """rows(symbol, ts, ...) with missing values of a column by policy: the row goes; the last or the next value of the
    symbol; the straight line by rows between both, the nearest one at either end; nothing; or an error if one is missing."""
    if policy not in POLICIES:
        raise ValueError(f"a policy is one of {', '.join(POLICIES)}")
    own, w = F.col(column), Window.partitionBy("symbol").orderBy("ts")
    if policy == "LEAVE":
        return rows
    if policy == "FAIL":
        if not rows.where(own.isNull()).isEmpty():
            raise ValueError(f"{column} has missing values")
        return rows
    if policy == "DROP":
        return rows.where(own.isNotNull())
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    if policy in ("FFILL", "BFILL"):
        return rows.withColumn(column, F.last(own, True).over(back) if policy == "FFILL" else F.first(own, True).over(ahead))
    placed = rows.withColumn("_k", F.row_number().over(w))
    point = F.when(own.isNotNull(), F.struct(F.col("_k").alias("k"), own.alias("v")))
    placed = placed.withColumns({"_a": F.last(point, True).over(back), "_b": F.first(point, True).over(ahead)})
    a, b, k = F.col("_a"), F.col("_b"), F.col("_k")
    line = a["v"] + (b["v"] - a["v"]) * (k - a["k"]) / (b["k"] - a["k"])
    return placed.withColumn(column, F.coalesce(own, F.when(a.isNotNull() & b.isNotNull(), line), a["v"], b["v"])).drop("_k", "_a", "_b")


def provider_adjusted(rows: DataFrame, adjusted: str = "adj_close") -> DataFrame:
    """Prices of a bar times the provider's ratio of adjusted to raw close; a bar without a ratio (null, or a close of 0) stays
    as it is. Adds ratio and was_adjusted."""
    ratio = F.try_divide(F.col(adjusted), F.col("close"))
    given = rows.withColumn("ratio", F.when(ratio > 0, ratio))
    moved = {c: F.coalesce(F.col(c) * F.col("ratio"), F.col(c)) for c in ("open", "high", "low", "close")}
    return given.withColumns(moved | {"was_adjusted": F.coalesce(F.col("ratio") != 1, F.lit(False))})


FORBIDDEN = ("guarantee", "risk free", "sure win")


def scan_status(signals: DataFrame, score: float, confidence: float, final: float, forbidden: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """Adds status and reasons, by the first rule that ends the judgement: a signal without a direction, a score or a
    confidence too low (FILTERED), a risk reject (REJECTED), a final score too low (FILTERED), a forbidden phrase in the note
    (REJECTED). A direction to watch makes it WATCH_ONLY, which the later rules may still overrule; else PASSED."""
    watch = F.coalesce(F.col("direction").isin("WATCH", "FLAT", "AVOID"), F.lit(False))
    note = F.lower(F.coalesce("note", F.lit("")))
    phrase = F.lit(False)
    for p in forbidden:
        phrase = phrase | F.contains(note, F.lit(p))
    rules = [
        (F.col("direction").isNull(), "FILTERED", "NO_SIGNAL"), (F.coalesce(F.col("score") < score, F.lit(True)), "FILTERED", "SCORE"), (F.coalesce(F.col("confidence") < confidence, F.lit(True)), "FILTERED", "CONFIDENCE"),
        (F.coalesce(F.col("rejected"), F.lit(False)), "REJECTED", "RISK"), (F.coalesce(F.col("final") < final, F.lit(False)), "FILTERED", "FINAL_SCORE"), (phrase, "REJECTED", "FORBIDDEN"),
    ]
    status, reason = F.when(watch, "WATCH_ONLY").otherwise("PASSED"), F.lit(None).cast("string")
    for condition, s, r in reversed(rules):
        status, reason = F.when(condition, s).otherwise(status), F.when(condition, r).otherwise(reason)
    early = F.coalesce(reason.isin("NO_SIGNAL", "SCORE", "CONFIDENCE"), F.lit(False))
    return signals.withColumn("status", status).withColumn("reasons", F.array_compact(F.array(F.when(watch & ~early, "DIRECTION"), reason)))


#: Sort key: (column, sign); low cost and low volatility rank high.
SORT_KEYS = {
    "FINAL_SCORE": ("final", 1), "SIGNAL_SCORE": ("score", 1), "CONFIDENCE": ("confidence", 1), "RISK_REWARD": ("reward", 1), "LIQUIDITY": ("turnover", 1), "VOLUME_ACTIVITY": ("activity", 1), "MOMENTUM": ("momentum", 1),
    "TREND": ("trend", 1), "LOW_COST": ("cost_bps", -1), "LOW_VOLATILITY": ("atr_pct", -1), "ML_SCORE": ("ml_score", 1), "ML_PROBABILITY": ("ml_probability", 1),
}
LAST = 9999


def scan_ranking(judged: DataFrame, key: str, by: str, descending: bool = True) -> DataFrame:
    """Adds rank inside each value of `by`: passed and watched signals by the key, missing keys last, ties by symbol in the
    same direction; all others have rank LAST."""
    column, sign = SORT_KEYS[key]
    value, listed = F.col(column) * sign, F.col("status").isin("PASSED", "WATCH_ONLY")
    order = (F.desc_nulls_last(value), F.desc("symbol")) if descending else (F.asc_nulls_last(value), F.asc("symbol"))
    return judged.withColumn("rank", F.when(listed, F.row_number().over(Window.partitionBy(by, listed).orderBy(*order))).otherwise(LAST))


def breadth_divergences(rows: DataFrame, move: float = 0.005, change: float = 2.0) -> DataFrame:
    """rows(ts, index_return, breadth, new_highs, participation, volume_score, near_high), one for each day -> (ts, kind,
    strength): the index against the change of breadth, a high that few symbols confirm, and a rise on little volume."""
    before = F.lag("breadth").over(Window.orderBy("ts"))  # a row for each day
    moved = rows.withColumn("delta", F.col("breadth") - before)
    kinds = {
        "INDEX_UP_BREADTH_DOWN": ((F.col("index_return") > move) & (F.col("delta") < -change), 80.0), "INDEX_DOWN_BREADTH_UP": ((F.col("index_return") < -move) & (F.col("delta") > change), 80.0),
        "NEW_HIGH_NOT_CONFIRMED": (F.col("near_high") & (F.col("new_highs") < 30) & (F.col("participation") < 40), 70.0), "VOLUME": ((F.col("index_return") > move) & (F.col("volume_score") < 40), 60.0),
    }
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.lit(x).alias("strength"))) for k, (c, x) in kinds.items())), lambda s: s.isNotNull())
    return moved.select("ts", F.inline(found))


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("symbol", "ts", F.when(F.col("volume") < 40, F.col("close")).alias("value"))


def p13_six_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes of heavy days are missing: what each policy makes of them, a row for each policy that gives rows."""
    rows, out = _holed(spark, sf_dir), None
    for policy in POLICIES[:5]:
        part = fill_missing(rows, "value", policy).select(F.lit(policy).alias("policy"), "symbol", "ts", F.round("value", 6).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def p16_ratio_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider halves the prices before 1998 and has none for some symbols."""
    given = bars(spark, sf_dir).withColumn("adj_close", F.when(F.pmod("symbol", F.lit(4)) > 0, F.when(F.col("ts") < F.lit("1998-01-01").cast("date"), F.col("close") / 2).otherwise(F.col("close"))))
    return provider_adjusted(given).select("symbol", "ts", "open", "high", "low", "close", "was_adjusted")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_signals(spark, sf_dir)
    k = F.pmod(F.col("symbol") + F.dayofyear("day"), F.lit(20))
    rows = rows.withColumns({
        "direction": F.when(k == 0, F.lit(None)).when(k < 4, "WATCH").otherwise(F.col("direction")), "rejected": F.col("stop") <= 0, "final": F.round(F.col("score") * 0.7, 6), "note": F.when(k == 7, "A Sure Win here").otherwise("plain"),
        "activity": F.col("confidence") * 100, "momentum": F.round("reward", 6), "trend": F.col("score"), "ml_probability": F.col("ml_score") / 100,
    })
    return scan_status(rows, 60, 0.3, 45)


def p20_scan_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir).select("day", "symbol", "status", F.concat_ws(",", "reasons").alias("reasons"))


def t01_twelve_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each signal of a day by each key."""
    judged = _scanned(spark, sf_dir)
    for key in SORT_KEYS:
        judged = scan_ranking(judged, key, "day").withColumnRenamed("rank", f"by_{key.lower()}")
    return judged.select("day", "symbol", *(f"by_{k.lower()}" for k in SORT_KEYS))


def f18_calendar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday (Monday is 1), thirty days on, end of the month and of the week (Sunday), days to the shipment."""
    first = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").cast("date").alias("shipped"))
    day = F.col("o_orderdate").cast("date")
    rows = read(spark, sf_dir, "orders").join(first, "o_orderkey")
    return rows.select("o_orderkey", (F.weekday(day) + 1).alias("weekday"), F.date_add(day, 30).alias("later"), F.last_day(day).alias("month_end"), F.date_add(day, 6 - F.weekday(day)).alias("week_end"), F.datediff("shipped", day).alias("days"))


def f19_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: values in cents filtered and sorted, steps between neighbours by zipping, sums by type as a map, the map as
    JSON and read again."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))
    sums = events.groupBy("user_id", "event_type").agg(F.sum("cents").alias("cents")).groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "cents")))).alias("sums"))
    lists = events.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "cents"))), lambda e: e["cents"]).alias("v"))
    high = F.sort_array(F.filter("v", lambda x: x >= 10_000), False)
    steps = F.zip_with(F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0))), F.slice("v", 2, F.size("v")), lambda a, b: F.abs(b - a))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    text = F.to_json("sums")
    return lists.join(sums, "user_id").select(
        "user_id", F.array_join(F.slice(high, 1, 3), ",").alias("highest"), total(steps).alias("way"), total(F.map_values("sums")).alias("total"), text.alias("sums_json"),
        F.from_json(text, "map<string,bigint>")["error"].alias("errors"), F.size(F.map_filter("sums", lambda _, v: v > 100_000)).alias("large"),
    )


def b19_curve_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basket's daily return over the symbols that trade, and the logarithm of the product of all up to the day."""
    weights = POSITIONS.frame(spark, sf_dir).groupBy("symbol").agg(F.sum("weight").alias("w"))
    daily = RETURNS.frame(spark, sf_dir).join(weights, "symbol").groupBy("ts").agg((F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("r"), F.count("*").alias("n"))
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    return daily.select("ts", "n", F.round("r", 9).alias("r"), F.round(F.sum(F.ln(1 + F.col("r"))).over(w), 6).alias("log_curve"))


def a09_three_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = RETURNS.frame(spark, sf_dir)
    up: Column = (F.col("r") > 0).cast("double")
    daily = rows.groupBy("ts").agg(F.avg("r").alias("index_return"), (100 * F.avg(up)).alias("breadth"), (100 * F.avg((F.col("r") > 1).cast("double"))).alias("new_highs"), (100 * F.sum(up * F.col("volume")) / F.sum("volume")).alias("volume_score"))
    daily = daily.withColumns({"participation": F.col("breadth") * 0.9, "near_high": F.col("index_return") > 0})
    return breadth_divergences(daily)


QUERIES = {f.__name__: f for f in (p13_six_policies, p16_ratio_policy, p20_scan_status, t01_twelve_keys, f18_calendar_fields, f19_collections, b19_curve_product, a09_three_divergences)}
_SCAN = f"""{_SIGNALS_SQL},
k AS (SELECT *, (symbol + dayofyear(day)) % 20 AS k FROM signals),
s AS (SELECT day, symbol, CASE WHEN k = 0 THEN NULL WHEN k < 4 THEN 'WATCH' ELSE direction END AS direction, score, confidence, stop, round(score * 0.7, 6) AS final, k = 7 AS phrase, reward, turnover, cost_bps, atr_pct, ml_score FROM k),
j AS (SELECT *, CASE WHEN direction IS NULL THEN 'NO_SIGNAL' WHEN score < 60 THEN 'SCORE' WHEN confidence < 0.3 THEN 'CONFIDENCE' WHEN stop <= 0 THEN 'RISK' WHEN final < 45 THEN 'FINAL_SCORE' WHEN phrase THEN 'FORBIDDEN' END AS reason FROM s),
u AS (SELECT *, CASE WHEN reason IN ('RISK', 'FORBIDDEN') THEN 'REJECTED' WHEN reason IS NOT NULL THEN 'FILTERED' WHEN direction = 'WATCH' THEN 'WATCH_ONLY' ELSE 'PASSED' END AS status FROM j)"""
_KEYS = {"final_score": "final", "signal_score": "score", "confidence": "confidence", "risk_reward": "reward", "liquidity": "turnover", "volume_activity": "confidence", "momentum": "round(reward, 6)", "trend": "score", "low_cost": "-cost_bps", "low_volatility": "-atr_pct", "ml_score": "ml_score", "ml_probability": "ml_score"}
ORACLES = {
    "p13_six_policies": f"""WITH b AS (SELECT symbol, ts, CASE WHEN volume < 40 THEN close END AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM ({BARS_SQL}) x), n AS (SELECT symbol, k, v FROM b WHERE v IS NOT NULL),
j AS (SELECT b.*, p.k AS ak, p.v AS av, q.k AS bk, q.v AS bv FROM b ASOF LEFT JOIN n p ON p.symbol = b.symbol AND b.k >= p.k ASOF LEFT JOIN n q ON q.symbol = b.symbol AND b.k <= q.k)
SELECT 'DROP' AS policy, symbol, ts, v AS value FROM j WHERE v IS NOT NULL UNION ALL SELECT 'LEAVE', symbol, ts, v FROM j UNION ALL SELECT 'FFILL', symbol, ts, av FROM j UNION ALL SELECT 'BFILL', symbol, ts, bv FROM j
UNION ALL SELECT 'INTERPOLATE', symbol, ts, round(CASE WHEN ak = bk THEN v WHEN ak IS NULL THEN bv WHEN bk IS NULL THEN av ELSE (av * (bk - k) + bv * (k - ak)) / (bk - ak) END, 6) FROM j""",
    "p16_ratio_policy": f"SELECT symbol, ts, open * m AS open, high * m AS high, low * m AS low, close * m AS close, m <> 1 AS was_adjusted FROM (SELECT *, CASE WHEN symbol % 4 > 0 AND ts < DATE '1998-01-01' THEN 0.5 ELSE 1 END AS m FROM ({BARS_SQL}) b) q",
    "p20_scan_status": f"WITH {_SCAN} SELECT day, symbol, status, array_to_string(list_filter([CASE WHEN direction = 'WATCH' AND (reason IS NULL OR reason NOT IN ('SCORE', 'CONFIDENCE')) THEN 'DIRECTION' END, reason], lambda x: x IS NOT NULL), ',') AS reasons FROM u",
    "t01_twelve_keys": f"WITH {_SCAN}, l AS (SELECT * FROM u WHERE status IN ('PASSED', 'WATCH_ONLY')), r AS (SELECT day, symbol, {', '.join(f'row_number() OVER (PARTITION BY day ORDER BY {e} DESC NULLS LAST, symbol DESC) AS by_{k}' for k, e in _KEYS.items())} FROM l) SELECT u.day, u.symbol, {', '.join(f'coalesce(r.by_{k}, {LAST}) AS by_{k}' for k in _KEYS)} FROM u LEFT JOIN r ON r.day = u.day AND r.symbol = u.symbol",
    "f18_calendar_fields": "WITH f AS (SELECT l_orderkey AS k, min(l_shipdate)::DATE AS shipped FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_orderdate::DATE AS d, shipped FROM orders JOIN f ON k = o_orderkey) SELECT o_orderkey, isodow(d) AS weekday, d + 30 AS later, (date_trunc('month', d) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS month_end, (date_trunc('week', d) + INTERVAL 6 DAY)::DATE AS week_end, shipped - d AS days FROM o",
    "f19_collections": "WITH e AS (SELECT user_id, event_type, event_id, floor(value * 100 + 0.5)::BIGINT AS c FROM events), t AS (SELECT user_id, event_type, sum(c)::BIGINT AS c FROM e GROUP BY ALL), m AS (SELECT user_id, '{' || string_agg('\"' || event_type || '\":' || c, ',' ORDER BY event_type) || '}' AS j, sum(c)::BIGINT AS total, max(c) FILTER (event_type = 'error') AS errors, count(*) FILTER (c > 100000) AS large FROM t GROUP BY user_id), s AS (SELECT user_id, c, row_number() OVER (PARTITION BY user_id ORDER BY c DESC) AS k, abs(c - lag(c) OVER (PARTITION BY user_id ORDER BY event_id)) AS step FROM e), h AS (SELECT user_id, coalesce(string_agg(c::VARCHAR, ',' ORDER BY k) FILTER (k <= 3 AND c >= 10000), '') AS highest, coalesce(sum(step), 0)::BIGINT AS way FROM s GROUP BY user_id) SELECT user_id, highest, way, total, j AS sums_json, errors, large FROM h JOIN m USING (user_id)",
    "b19_curve_product": f"WITH p AS (SELECT symbol, sum(weight) AS w FROM ({POSITIONS.sql}) x GROUP BY symbol), d AS (SELECT ts, sum(w * r) / sum(w) AS r, count(*) AS n FROM ({RETURNS.sql}) y JOIN p USING (symbol) GROUP BY ts) SELECT ts, n, round(r, 9) AS r, round((SELECT ln(product(1 + b.r)) FROM d b WHERE b.ts <= d.ts AND b.ts > d.ts - 60) + coalesce((SELECT sum(ln(1 + b.r)) FROM d b WHERE b.ts <= d.ts - 60), 0), 6) AS log_curve FROM d",
    "a09_three_divergences": f"WITH d AS (SELECT ts, avg(r) AS m, 100 * avg((r > 0)::INT) AS b, 100 * avg((r > 1)::INT) AS h, 100 * sum(CASE WHEN r > 0 THEN volume ELSE 0 END) / sum(volume) AS v FROM ({RETURNS.sql}) x GROUP BY ts), e AS (SELECT *, b - lag(b) OVER (ORDER BY ts) AS g FROM d) SELECT ts, 'INDEX_UP_BREADTH_DOWN' AS kind, 80.0 AS strength FROM e WHERE m > 0.005 AND g < -2 UNION ALL SELECT ts, 'INDEX_DOWN_BREADTH_UP', 80.0 FROM e WHERE m < -0.005 AND g > 2 UNION ALL SELECT ts, 'NEW_HIGH_NOT_CONFIRMED', 70.0 FROM e WHERE m > 0 AND h < 30 AND b * 0.9 < 40 UNION ALL SELECT ts, 'VOLUME', 60.0 FROM e WHERE m > 0.005 AND v < 40",
}
