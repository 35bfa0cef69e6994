"""Divergences between price and an indicator: pivots of both are matched by their places in the series, pairs become
events with a strength, events become columns of each bar.

A pivot meets the nearest pivot of the other series within a few bars, and an older pair within a range of bars. Both are
frames of one window over places, so a symbol's bars are shuffled once and no two rows are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from barloom.sources.bars import BARS_SQL, bars

LOOKBACK, CONFIRM = 5, 3  #: bars before a pivot, and after it where it is confirmed
NEAR = 2  #: bars between a price pivot and its indicator pivot at most
LEAST, MOST = 3, 60  #: bars between an older pair and a newer one
FAR, FAR_COST, CONFIRMED_BONUS = 30, 0.5, 10.0
KINDS = ("REGULAR_BULLISH", "REGULAR_BEARISH", "HIDDEN_BULLISH", "HIDDEN_BEARISH")


def _by_place() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("pos")


def _pivot(series: str, high: bool, confirm: int, lookback: int) -> Column:
    """Whether the row is a pivot. Unconfirmed: beyond the `lookback` values before it. Confirmed: the extremum of those, of
    itself and of the `confirm` values after it, and strictly beyond the latter; bars without a full window are none."""
    w, value = _by_place(), F.col(series)
    extremum, beyond = (F.max, lambda a, b: a > b) if high else (F.min, lambda a, b: a < b)
    before = w.rowsBetween(-lookback, -1)
    if not confirm:
        return F.coalesce((F.count(value).over(before) == lookback) & beyond(value, extremum(value).over(before)), F.lit(False))
    whole, after = w.rowsBetween(-lookback, confirm), w.rowsBetween(1, confirm)
    full = F.count(value).over(whole) == lookback + confirm + 1
    return F.coalesce(full & (value == extremum(value).over(whole)) & beyond(value, extremum(value).over(after)), F.lit(False))


def _nearest(series: str, flag: str, near: int) -> Column:
    """(pos, value) of the pivot nearest to the row, the earlier one of two as near."""
    w = _by_place()
    point = F.when(F.col(flag), F.struct("pos", F.col(series).alias("value")))
    return F.coalesce(*(F.lag(point, k).over(w) for k in sorted(range(-near, near + 1), key=lambda k: (abs(k), -k))))


def pivot_pairs(rows: DataFrame, price: str, indicator: str, confirm: int = 0, lookback: int = LOOKBACK, near: int = NEAR, least: int = LEAST, most: int = MOST) -> DataFrame:
    """rows(symbol, ts, price, indicator) -> a row for each price pivot that has an indicator pivot within `near` bars and
    an older such pivot `least` to `most` bars before, whose indicator pivot is older too: symbol, side (HIGH, LOW), ts, pos,
    price_1, price_2, indicator_1, indicator_2, bars, told_pos. 1 is the older pair and the nearest one that fits. A pivot
    is known `confirm` bars after it (told_pos). Null values are no pivots; an empty table gives none."""
    w = _by_place()
    out = None
    placed = rows.select("symbol", "ts", F.col(price).cast("double").alias("p"), F.col(indicator).cast("double").alias("i")).withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    for high in (True, False):
        flagged = placed.withColumns({"p_pivot": _pivot("p", high, confirm, lookback), "i_pivot": _pivot("i", high, confirm, lookback)})
        matched = flagged.withColumn("own", F.when(F.col("p_pivot"), _nearest("i", "i_pivot", near)))
        mine = F.when(F.col("own").isNotNull(), F.struct("pos", "p", F.col("own.pos").alias("i_pos"), F.col("own.value").alias("i")))
        pivots = matched.withColumn("mine", mine).where("mine is not null")
        # The matched pivots of two price pivots more than 2 * near bars apart are in order; closer ones are looked at one by one.
        close = [F.last("mine", True).over(w.rangeBetween(-d, -d)) for d in range(least, min(most, 2 * near) + 1)]
        older = [F.when(c["i_pos"] < F.col("own.pos"), c) for c in close]
        if most > 2 * near:
            older.append(F.last("mine", True).over(w.rangeBetween(-most, -max(least, 2 * near + 1))))
        pairs = pivots.withColumn("older", F.coalesce(*older)).where("older is not null").select(
            "symbol", F.lit("HIGH" if high else "LOW").alias("side"), "ts", "pos", F.col("older.p").alias("price_1"), F.col("p").alias("price_2"),
            F.col("older.i").alias("indicator_1"), F.col("own.value").alias("indicator_2"), (F.col("pos") - F.col("older.pos")).alias("bars"), (F.col("pos") + confirm).alias("told_pos"),
        )
        out = pairs if out is None else out.unionByName(pairs)
    return out


def divergence_events(pairs: DataFrame, confirmed: bool = False, least_strength: float = 0.0, regular: bool = True, hidden: bool = True) -> DataFrame:
    """pivot_pairs -> the pairs that diverge, with kind, strength (0 to 100) and class. Regular: price goes beyond its older
    pivot and the indicator does not; hidden: the reverse. Strength grows with both differences in per cent, falls where the
    pair is more than FAR bars long and is 50 where an older value is 0."""
    up, rises = F.col("price_2") > F.col("price_1"), F.col("indicator_2") > F.col("indicator_1")
    down, falls = F.col("price_2") < F.col("price_1"), F.col("indicator_2") < F.col("indicator_1")
    high = F.col("side") == "HIGH"
    kind = (
        F.when(F.lit(regular) & high & up & falls, "REGULAR_BEARISH").when(F.lit(hidden) & high & down & rises, "HIDDEN_BEARISH")
        .when(F.lit(regular) & ~high & down & rises, "REGULAR_BULLISH").when(F.lit(hidden) & ~high & up & falls, "HIDDEN_BULLISH")
    )
    moved = lambda a, b: F.abs((F.col(b) - F.col(a)) / F.nullif(F.col(a), F.lit(0.0))) * 100
    raw = moved("price_1", "price_2") * 5 + moved("indicator_1", "indicator_2") * 2 - F.greatest(F.col("bars") - FAR, F.lit(0)) * FAR_COST + (CONFIRMED_BONUS if confirmed else 0.0)
    strength = F.when((F.col("price_1") == 0) | (F.col("indicator_1") == 0), 50.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)))
    name = F.when(F.col("strength") < 33, "WEAK").when(F.col("strength") < 66, "MEDIUM").otherwise("STRONG")
    return pairs.withColumn("kind", kind).where("kind is not null").withColumn("strength", strength).where(F.col("strength") >= least_strength).withColumn("class", name)


def divergence_features(rows: DataFrame, events: DataFrame) -> DataFrame:
    """A row for each bar: 1.0 or 0.0 for each kind told there, the greatest strength, the direction (a bullish event
    outweighs a bearish one of the same bar) and the bars since the last event (-1 before the first)."""
    placed = rows.select("symbol", "ts", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")).alias("pos"))
    told = events.groupBy("symbol", F.col("told_pos").alias("pos")).agg(*(F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(k.lower()) for k in KINDS), F.max("strength").alias("strength"))
    joined = placed.join(told, ["symbol", "pos"], "left").fillna(0.0, [k.lower() for k in KINDS] + ["strength"])
    some = lambda side: (F.col(f"regular_{side}") + F.col(f"hidden_{side}")) > 0
    last = F.last(F.when(some("bullish") | some("bearish"), F.col("pos")), True).over(_by_place().rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumns({"direction": F.when(some("bullish"), 1.0).when(some("bearish"), -1.0).otherwise(0.0), "bars_since": F.coalesce(F.col("pos") - last, F.lit(-1))})


def _momentum(spark: SparkSession, sf_dir: str, span: int = 10) -> DataFrame:
    return bars(spark, sf_dir).withColumn("momentum", F.col("close") - F.lag("close", span).over(Window.partitionBy("symbol").orderBy("ts")))


def wd3_pivot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_pairs(_momentum(spark, sf_dir), "close", "momentum")


def wd4_divergence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots confirmed by the bars after them."""
    events = divergence_events(pivot_pairs(_momentum(spark, sf_dir), "close", "momentum", CONFIRM), True)
    return events.withColumn("strength", F.round("strength", 6)).select("symbol", "side", "ts", "told_pos", "bars", "kind", "strength", "class")


def wd5_divergence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _momentum(spark, sf_dir)
    return divergence_features(rows, divergence_events(pivot_pairs(rows, "close", "momentum"))).withColumn("strength", F.round("strength", 6)).drop("pos")


def wd3_wd4_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of unconfirmed pivots."""
    return divergence_events(pivot_pairs(_momentum(spark, sf_dir), "close", "momentum")).select("symbol", "ts", "kind", F.col("bars").alias("bars_apart"))


QUERIES = {f.__name__: f for f in (wd3_pivot_pairs, wd4_divergence_events, wd5_divergence_features, wd3_wd4_divergences)}


def _pairs_sql(confirm: int) -> str:
    """Pivots as lists of rows, matched and paired by joins over distances."""
    whole = f"ROWS BETWEEN {LOOKBACK} PRECEDING AND {confirm} FOLLOWING"
    flags = []
    for side, extremum, beyond in (("high", "max", ">"), ("low", "min", "<")):
        for s in "pi":
            if confirm:
                flag = f"count({s}) OVER (w {whole}) = {LOOKBACK + confirm + 1} AND {s} = {extremum}({s}) OVER (w {whole}) AND {s} {beyond} {extremum}({s}) OVER (w ROWS BETWEEN 1 FOLLOWING AND {confirm} FOLLOWING)"
            else:
                back = f"(w ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING)"
                flag = f"count({s}) OVER {back} = {LOOKBACK} AND {s} {beyond} {extremum}({s}) OVER {back}"
            flags.append(f"{flag} AS {s}_{side}")
    pivots = lambda s: " UNION ALL ".join(f"SELECT symbol, '{side.upper()}' AS side, ts, pos, {s} AS v FROM flagged WHERE {s}_{side}" for side in ("high", "low"))
    return f"""b AS ({BARS_SQL}),
placed AS (SELECT symbol, ts, close AS p, close - lag(close, 10) OVER (PARTITION BY symbol ORDER BY ts) AS i, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM b),
flagged AS (SELECT symbol, ts, pos, p, i, {", ".join(flags)} FROM placed WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
prices AS ({pivots("p")}), others AS ({pivots("i")}),
matched AS (SELECT p.*, o.pos AS i_pos, o.v AS i FROM prices p JOIN others o ON p.symbol = o.symbol AND p.side = o.side AND abs(p.pos - o.pos) <= {NEAR} QUALIFY row_number() OVER (PARTITION BY p.symbol, p.side, p.pos ORDER BY abs(p.pos - o.pos), o.pos) = 1),
pairs AS (
  SELECT n.symbol, n.side, n.ts, n.pos, a.v AS price_1, n.v AS price_2, a.i AS indicator_1, n.i AS indicator_2, n.pos - a.pos AS bars, n.pos + {confirm} AS told_pos
  FROM matched n JOIN matched a ON n.symbol = a.symbol AND n.side = a.side AND n.pos - a.pos BETWEEN {LEAST} AND {MOST} AND a.i_pos < n.i_pos QUALIFY row_number() OVER (PARTITION BY n.symbol, n.side, n.pos ORDER BY a.pos DESC) = 1)"""


def _events_sql(confirmed: bool) -> str:
    return f"""events AS (
  SELECT *, CASE WHEN strength < 33 THEN 'WEAK' WHEN strength < 66 THEN 'MEDIUM' ELSE 'STRONG' END AS class FROM (
    SELECT *, CASE WHEN side = 'HIGH' THEN CASE WHEN price_2 > price_1 AND indicator_2 < indicator_1 THEN 'REGULAR_BEARISH' WHEN price_2 < price_1 AND indicator_2 > indicator_1 THEN 'HIDDEN_BEARISH' END
      ELSE CASE WHEN price_2 < price_1 AND indicator_2 > indicator_1 THEN 'REGULAR_BULLISH' WHEN price_2 > price_1 AND indicator_2 < indicator_1 THEN 'HIDDEN_BULLISH' END END AS kind,
      CASE WHEN price_1 = 0 OR indicator_1 = 0 THEN 50.0 ELSE least(100.0, greatest(0.0, abs((price_2 - price_1) / price_1) * 500 + abs((indicator_2 - indicator_1) / indicator_1) * 200 - CASE WHEN bars > {FAR} THEN (bars - {FAR}) * {FAR_COST} ELSE 0 END + {CONFIRMED_BONUS if confirmed else 0})) END AS strength
    FROM pairs) k WHERE kind IS NOT NULL)"""


ORACLES = {
    "wd3_pivot_pairs": f"WITH {_pairs_sql(0)} SELECT * FROM pairs",
    "wd4_divergence_events": f"WITH {_pairs_sql(CONFIRM)}, {_events_sql(True)} SELECT symbol, side, ts, told_pos, bars, kind, round(strength, 6) AS strength, class FROM events",
    "wd3_wd4_divergences": f"WITH {_pairs_sql(0)}, {_events_sql(False)} SELECT symbol, ts, kind, bars AS bars_apart FROM events",
    "wd5_divergence_features": f"""WITH {_pairs_sql(0)}, {_events_sql(False)},
joined AS (SELECT p.symbol, p.ts, p.pos, {", ".join(f"CAST(count(e.kind) FILTER (e.kind = '{k}') > 0 AS DOUBLE) AS {k.lower()}" for k in KINDS)}, coalesce(max(e.strength), 0) AS strength FROM placed p LEFT JOIN events e ON e.symbol = p.symbol AND e.told_pos = p.pos GROUP BY p.symbol, p.ts, p.pos)
SELECT symbol, ts, {", ".join(k.lower() for k in KINDS)}, round(strength, 6) AS strength, CASE WHEN regular_bullish + hidden_bullish > 0 THEN 1.0 WHEN regular_bearish + hidden_bearish > 0 THEN -1.0 ELSE 0.0 END AS direction,
  coalesce(pos - (SELECT max(e.told_pos) FROM events e WHERE e.symbol = j.symbol AND e.told_pos <= j.pos), -1) AS bars_since FROM joined j""",
}
