"""Votes of several sources on each symbol and day: weights by regime, conflicts among them, one decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.sources.bars import BARS_SQL, bars, parts
from barloom.sources.tables import INSTRUMENTS

#: Base weight of a source and its factor in a regime (others: 1).
WEIGHTS = {"STRATEGY": 0.25, "INDICATOR": 0.15, "PATTERN": 0.10, "ML": 0.20, "FUNDAMENTAL": 0.10, "BREADTH": 0.10, "RISK": 0.10}
FACTORS = {
    "TRENDING": {"STRATEGY": 1.2, "BREADTH": 1.2, "RISK": 0.8},
    "RANGE": {"PATTERN": 1.5, "STRATEGY": 0.8},
    "STRESSED": {"RISK": 1.5, "BREADTH": 1.5, "STRATEGY": 0.5, "ML": 0.5},
}
#: Points of each conflict, by severity, and what it recommends.
CONFLICTS = {"directional": 15, "ml_technical": 30, "fundamental_technical": 15, "breadth_signal": 15, "risk": 50, "stale": 30}
DECISIONS = ("APPROVED", "WATCH_ONLY", "CONFLICTED", "INSUFFICIENT_AGREEMENT", "REJECTED")
TECHNICAL = ("STRATEGY", "INDICATOR", "PATTERN")


def regime_weights(spark: SparkSession) -> DataFrame:
    """(regime, source, weight): base weights times factors, one in all for each regime; other regimes have none."""
    rows = []
    for regime, factors in FACTORS.items():
        raw = {s: w * factors.get(s, 1.0) for s, w in WEIGHTS.items()}
        rows += [(regime, s, w / sum(raw.values())) for s, w in raw.items()]
    return spark.createDataFrame(rows, "regime string, source string, weight double")


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def consensus(votes: DataFrame, weights: DataFrame) -> DataFrame:
    """votes(symbol, ts, regime, source, direction, score, confidence, stale) -> one row for each symbol and day.

    Scores of shorts are mirrored, those of rejects count 0, missing ones 50. Sources without weight in the regime have no
    vote, but in conflicts of risk and staleness. agreement is the share of the most frequent direction among the votes.
    A reject needs more than half the weight of longs and shorts, a direction 1.5 times the weight of the other."""
    w = F.coalesce("weight", F.lit(0.0))
    joined = votes.join(F.broadcast(weights), ["regime", "source"], "left").withColumn("w", w)
    score = F.coalesce("score", F.lit(50.0))
    own = F.when(F.col("direction") == "SHORT", 100 - score).when(F.col("direction") == "REJECT", 0.0).otherwise(score)
    active, is_ = F.col("w") > 0, lambda d: F.col("direction") == d
    source = lambda *s: F.col("source").isin(*s)
    weight_of = lambda d: F.sum(F.when(is_(d), F.col("w")).otherwise(0.0))
    counts = [F.count_if(active & is_(d)) for d in ("LONG", "SHORT", "NEUTRAL", "REJECT", "WATCH")]
    total = F.sum("w")
    ml = F.min(F.when(active & source("ML"), F.col("direction")))
    technical = lambda d: _any(active & source(*TECHNICAL) & is_(d))
    found = joined.groupBy("symbol", "ts", "regime").agg(
        F.coalesce(F.sum(F.when(active, F.col("w") * own)) / F.nullif(total, F.lit(0.0)), F.lit(50.0)).alias("score"),
        F.coalesce(F.sum(F.when(active, F.col("w") * F.coalesce("confidence", F.lit(50.0)))) / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.greatest(*counts) / F.nullif(F.count_if(active), F.lit(0)), F.lit(0.0)).alias("agreement"),
        weight_of("LONG").alias("longs"), weight_of("SHORT").alias("shorts"), weight_of("REJECT").alias("rejects"), F.count_if(active).alias("n"),
        (_any(active & is_("LONG")) & _any(active & is_("SHORT"))).alias("directional"),
        (F.coalesce(ml != "NEUTRAL", F.lit(False)) & ((technical("LONG") & (ml != "LONG")) | (technical("SHORT") & (ml != "SHORT")) | (technical("REJECT") & (ml != "REJECT")) | (technical("WATCH") & (ml != "WATCH")))).alias("ml_technical"),
        (_any(active & source("FUNDAMENTAL") & is_("SHORT")) & _any(active & source("STRATEGY", "INDICATOR") & is_("LONG"))).alias("fundamental_technical"),
        (_any(active & source("BREADTH") & is_("SHORT")) & _any(active & source("STRATEGY") & is_("LONG"))).alias("breadth_signal"),
        (_any(source("RISK") & is_("REJECT")) & _any(is_("LONG"))).alias("risk"), _any(F.col("stale")).alias("stale"),
    )
    points = sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p in CONFLICTS.items()), F.lit(0))
    voted = F.when(F.col("n") == 0, "UNKNOWN").when((F.col("rejects") > 0) & (F.col("rejects") > (F.col("longs") + F.col("shorts")) * 0.5), "REJECT").when(F.col("longs") > F.col("shorts") * 1.5, "LONG").when(F.col("shorts") > F.col("longs") * 1.5, "SHORT").otherwise("NEUTRAL")
    advice = F.when(F.col("risk"), "REJECTED").when(F.coalesce("ml_technical", F.lit(False)), "CONFLICTED").when(F.col("fundamental_technical") | F.col("stale"), "WATCH_ONLY").when(F.col("directional") | F.col("breadth_signal"), "REDUCE").otherwise("APPROVED")
    decided = (
        F.when(F.col("advice") == "REJECTED", "REJECTED").when(F.col("agreement") < 0.6, "INSUFFICIENT_AGREEMENT").when(F.col("conflict") > 60, "CONFLICTED")
        .when((F.col("score") >= 70) & (F.col("confidence") >= 55) & (F.col("conflict") <= 35) & ~F.col("advice").isin("REDUCE", "WATCH_ONLY"), "APPROVED")
        .when((F.col("score") >= 55) | (F.col("advice") == "WATCH_ONLY"), "WATCH_ONLY").otherwise("REJECTED")
    )
    judged = found.withColumns({"conflict": F.least(F.lit(100), points), "voted": voted, "advice": advice}).withColumn("decision", decided)
    final = F.when(F.col("decision") == "REJECTED", "REJECT").when(F.col("decision").isin("WATCH_ONLY", "CONFLICTED") & (F.col("voted") == "UNKNOWN"), "WATCH").otherwise(F.col("voted"))
    return judged.withColumn("direction", final)


def ranked(found: DataFrame) -> DataFrame:
    """Adds place inside a day: by decision, then score, confidence and agreement, high first, then conflict and symbol."""
    order = F.array_position(F.array(*map(F.lit, DECISIONS)), F.col("decision"))
    by = Window.partitionBy("ts").orderBy(order, F.desc(F.round("score", 9)), F.desc(F.round("confidence", 9)), F.desc(F.round("agreement", 9)), "conflict", "symbol")
    return found.withColumn("place", F.row_number().over(by))


def bar_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on every symbol and day of the bars; a symbol whose bar before is more than 25 days old is stale."""
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars(spark, sf_dir).withColumns({"before": F.lag("close").over(w), "k": F.row_number().over(w), "mean": F.avg("close").over(w.rowsBetween(-19, 0)), "top": F.max("high").over(w.rowsBetween(-20, -1)), "days": F.datediff("ts", F.lag("ts").over(w)), "ago": F.lag("close", 10).over(w)}).where("k > 20")
    rows = rows.join(INSTRUMENTS.frame(spark, sf_dir).select("symbol", "size"), "symbol")
    # By day from here on: the breadth, the votes of a bar and its place need no other shuffle.
    rows = rows.repartition(parts(spark, sf_dir), "ts")
    up = F.avg((F.col("close") > F.col("before")).cast("double")).over(Window.partitionBy("ts"))
    rows = rows.withColumn("up", F.round(up, 6)).withColumn("regime", F.when(F.col("up") >= 0.6, "TRENDING").when(F.col("up") <= 0.3, "STRESSED").otherwise("RANGE"))
    side = lambda a, b: F.when(a > b, "LONG").when(a < b, "SHORT").otherwise("NEUTRAL")
    c = F.col("close")
    strength = F.least(F.lit(100.0), F.floor(F.abs(c / F.col("mean") - 1) * 100))
    votes = [
        ("STRATEGY", side(c, F.col("mean")), 50 + strength / 2, F.lit(70.0)), ("INDICATOR", side(c, F.col("ago")), F.lit(80.0), F.lit(60.0)), ("PATTERN", F.when(c > F.col("top"), "LONG").otherwise("NEUTRAL"), F.lit(None).cast("double"), F.lit(None).cast("double")),
        ("ML", F.when(F.pmod(F.col("symbol") + F.col("k"), F.lit(5)) == 0, "SHORT").when(F.pmod(F.col("symbol") + F.col("k"), F.lit(5)) < 4, "LONG").otherwise("NEUTRAL"), (40 + F.pmod(F.col("k"), F.lit(60))).cast("double"), F.lit(65.0)),
        ("FUNDAMENTAL", F.when(F.col("size") > 3000, "LONG").when(F.col("size") < 0, "SHORT").otherwise("NEUTRAL"), F.lit(75.0), F.lit(50.0)), ("BREADTH", F.when(F.col("up") > 0.5, "LONG").otherwise("SHORT"), F.lit(85.0), F.lit(80.0)),
        ("RISK", F.when(c / F.col("mean") > 2.5, "REJECT").otherwise("LONG"), F.lit(90.0), F.lit(90.0)),
    ]
    given = F.array(*(F.struct(F.lit(s).alias("source"), d.alias("direction"), x.cast("double").alias("score"), y.alias("confidence")) for s, d, x, y in votes))
    return rows.select("symbol", "ts", "regime", (F.col("days") > 25).alias("stale"), F.inline(given))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(consensus(bar_votes(spark, sf_dir), regime_weights(spark)))


def e01_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("symbol", "ts", "place", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), F.round("agreement", 6).alias("agreement"), "conflict", "direction", "decision")


def e02_regime_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as they apply to the votes of each day: by day and source, with the number of votes."""
    votes = bar_votes(spark, sf_dir).groupBy("ts", "regime", "source").agg(F.count("*").alias("n"))
    return votes.join(F.broadcast(regime_weights(spark)), ["regime", "source"]).select("ts", "regime", "source", "n", F.round("weight", 9).alias("weight"))


def e03_six_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consensus(bar_votes(spark, sf_dir), regime_weights(spark))
    return rows.select("symbol", "ts", *(F.col(c).cast("int").alias(c) for c in CONFLICTS), "conflict", "advice")


QUERIES = {f.__name__: f for f in (e01_consensus, e02_regime_weights, e03_six_conflicts)}
_W = ", ".join(f"('{r}', '{s}', {w * FACTORS[r].get(s, 1.0) / sum(x * FACTORS[r].get(k, 1.0) for k, x in WEIGHTS.items())!r}::DOUBLE)" for r in FACTORS for s, w in WEIGHTS.items())
#: Votes as a list on each row, judged by list functions.
_VOTED = f"""WITH b AS ({BARS_SQL}),
x AS (SELECT b.*, s_acctbal AS size, lag(close) OVER w AS before, row_number() OVER w AS k, avg(close) OVER (w ROWS 19 PRECEDING) AS mean, max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS top, ts - lag(ts) OVER w AS days, lag(close, 10) OVER w AS ago FROM b JOIN supplier ON s_suppkey = symbol WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
y AS (SELECT *, round(avg((close > before)::INT) OVER (PARTITION BY ts), 6) AS up FROM x WHERE k > 20),
wt(regime, source, w) AS (VALUES {_W}),
z AS (SELECT *, CASE WHEN up >= 0.6 THEN 'TRENDING' WHEN up <= 0.3 THEN 'STRESSED' ELSE 'RANGE' END AS regime,
  CASE WHEN close > mean THEN 'LONG' WHEN close < mean THEN 'SHORT' ELSE 'NEUTRAL' END AS st, CASE WHEN close > ago THEN 'LONG' WHEN close < ago THEN 'SHORT' ELSE 'NEUTRAL' END AS ind, CASE WHEN close > top THEN 'LONG' ELSE 'NEUTRAL' END AS pat,
  CASE WHEN (symbol + k) % 5 = 0 THEN 'SHORT' WHEN (symbol + k) % 5 < 4 THEN 'LONG' ELSE 'NEUTRAL' END AS ml, CASE WHEN size > 3000 THEN 'LONG' WHEN size < 0 THEN 'SHORT' ELSE 'NEUTRAL' END AS fun, CASE WHEN up > 0.5 THEN 'LONG' ELSE 'SHORT' END AS br, CASE WHEN close / mean > 2.5 THEN 'REJECT' ELSE 'LONG' END AS ri FROM y),
v AS (SELECT symbol, ts, regime, coalesce(days > 25, FALSE) AS stale, st, ind, pat, ml, fun, br, ri, [{{'s': 'STRATEGY', 'd': st, 'x': 50 + least(100, floor(abs(close / mean - 1) * 100)) / 2, 'c': 70}}, {{'s': 'INDICATOR', 'd': ind, 'x': 80, 'c': 60}}, {{'s': 'PATTERN', 'd': pat, 'x': 50, 'c': 50}}, {{'s': 'ML', 'd': ml, 'x': 40 + k % 60, 'c': 65}}, {{'s': 'FUNDAMENTAL', 'd': fun, 'x': 75, 'c': 50}}, {{'s': 'BREADTH', 'd': br, 'x': 85, 'c': 80}}, {{'s': 'RISK', 'd': ri, 'x': 90, 'c': 90}}] AS l FROM z)"""
_CONFLICT = f"""{_VOTED},
wm AS (SELECT regime, map_from_entries(list((source, w))) AS m FROM wt GROUP BY regime),
f AS (SELECT v.*, m, list_contains(ds, 'LONG') AND list_contains(ds, 'SHORT') AS directional, ml <> 'NEUTRAL' AND len(list_filter([st, ind, pat], lambda d: d <> 'NEUTRAL' AND d <> ml)) > 0 AS ml_technical, fun = 'SHORT' AND (st = 'LONG' OR ind = 'LONG') AS fundamental_technical, br = 'SHORT' AND st = 'LONG' AS breadth_signal, ri = 'REJECT' AND list_contains(ds, 'LONG') AS risk, ds FROM (SELECT *, list_transform(l, lambda r: r.d) AS ds FROM v) v JOIN wm USING (regime)),
g AS (SELECT *, least(100, 15 * directional::INT + 30 * ml_technical::INT + 15 * fundamental_technical::INT + 15 * breadth_signal::INT + 50 * risk::INT + 30 * stale::INT) AS conflict, CASE WHEN risk THEN 'REJECTED' WHEN ml_technical THEN 'CONFLICTED' WHEN fundamental_technical OR stale THEN 'WATCH_ONLY' WHEN directional OR breadth_signal THEN 'REDUCE' ELSE 'APPROVED' END AS advice FROM f)"""
ORACLES = {
    "e01_consensus": f"""{_CONFLICT},
h AS (SELECT *, list_sum(list_transform(l, lambda r: m[r.s] * CASE r.d WHEN 'SHORT' THEN 100 - r.x WHEN 'REJECT' THEN 0 ELSE r.x END)) AS score, list_sum(list_transform(l, lambda r: m[r.s] * r.c)) AS confidence, list_max(list_transform(['LONG', 'SHORT', 'NEUTRAL', 'REJECT'], lambda d: len(list_filter(ds, lambda e: e = d)))) / 7 AS agreement,
  list_sum(list_transform(l, lambda r: CASE WHEN r.d = 'LONG' THEN m[r.s] ELSE 0 END)) AS longs, list_sum(list_transform(l, lambda r: CASE WHEN r.d = 'SHORT' THEN m[r.s] ELSE 0 END)) AS shorts, list_sum(list_transform(l, lambda r: CASE WHEN r.d = 'REJECT' THEN m[r.s] ELSE 0 END)) AS rejects FROM g),
j AS (SELECT *, CASE WHEN rejects > 0 AND rejects > (longs + shorts) * 0.5 THEN 'REJECT' WHEN longs > shorts * 1.5 THEN 'LONG' WHEN shorts > longs * 1.5 THEN 'SHORT' ELSE 'NEUTRAL' END AS voted,
  CASE WHEN advice = 'REJECTED' THEN 'REJECTED' WHEN agreement < 0.6 THEN 'INSUFFICIENT_AGREEMENT' WHEN conflict > 60 THEN 'CONFLICTED' WHEN score >= 70 AND confidence >= 55 AND conflict <= 35 AND advice NOT IN ('REDUCE', 'WATCH_ONLY') THEN 'APPROVED' WHEN score >= 55 OR advice = 'WATCH_ONLY' THEN 'WATCH_ONLY' ELSE 'REJECTED' END AS decision FROM h)
SELECT symbol, ts, row_number() OVER (PARTITION BY ts ORDER BY list_position(['APPROVED', 'WATCH_ONLY', 'CONFLICTED', 'INSUFFICIENT_AGREEMENT', 'REJECTED'], decision), round(score, 9) DESC, round(confidence, 9) DESC, round(agreement, 9) DESC, conflict, symbol) AS place, round(score, 6) AS score, round(confidence, 6) AS confidence, round(agreement, 6) AS agreement, conflict, CASE WHEN decision = 'REJECTED' THEN 'REJECT' ELSE voted END AS direction, decision FROM j""",
    "e02_regime_weights": f"{_VOTED} SELECT ts, regime, r.s AS source, count(*) AS n, round(any_value(w), 9) AS weight FROM (SELECT ts, regime, unnest(l) AS r FROM v) q JOIN wt USING (regime) WHERE wt.source = r.s GROUP BY ts, regime, r.s",
    "e03_six_conflicts": f"{_CONFLICT} SELECT symbol, ts, {', '.join(f'{c}::INT AS {c}' for c in CONFLICTS)}, conflict, advice FROM g",
}
