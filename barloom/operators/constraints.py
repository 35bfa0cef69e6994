"""Weights under limits: caps whose excess goes to the others, scaling of groups, turnover, limits that are broken."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.correlation import _CLUSTERS, _P, _R, b15_correlation_clusters
from barloom.sources.tables import POSITIONS, RETURNS


def water_filled(rows: DataFrame, cap: float, portfolio: str = "portfolio", weight: str = "weight") -> DataFrame:
    """Adds capped: no weight of a portfolio above `cap`, and what is cut off goes to the others in proportion to their
    weights, again and again, so that the total stays (or every positive weight is at the cap, if even that is less).

    Only a total / cap of the largest weights can end at the cap, so the level is found on those alone: with k of them at
    the cap, the others are scaled by (total - k * cap) / (total - the sum of those k); the first k that leaves the next
    one under the cap holds. A portfolio may hold any number of rows, of which a task sees the top and partial sums.
    Weights that are null or not positive get 0; an empty table gives an empty one."""
    if not 0 < cap <= 1:
        raise ValueError("a cap is above 0 and at most 1")
    w, most = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)), ceil(1 / cap)
    own = rows.select(F.col(portfolio).alias("p"), w.alias("w")).where("w > 0")
    totals = own.groupBy("p").agg(F.sum("w").alias("total"), F.count("*").alias("n"))
    order = Window.partitionBy("p").orderBy(F.desc("w"))
    # Weights are shares of the total here: row_number() <= most is a limit that Spark applies before the shuffle, too.
    top = own.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most + 1).join(totals, "p").withColumn("w", F.col("w") / F.col("total"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy("p").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = F.try_divide(1 - (F.col("k") - 1) * cap, 1 - before)
    fits = top.withColumn("level", level).where(F.col("level") * F.col("w") <= cap + 1e-12)
    levels = fits.groupBy("p").agg(F.min_by("level", "k").alias("level"))
    found = totals.join(levels, "p", "left").select("p", "total", F.when(F.col("n") * cap <= 1, F.lit(None)).otherwise(F.col("level")).alias("level"))
    joined = rows.join(found, F.col(portfolio).eqNullSafe(F.col("p")), "left")
    share = F.when(w > 0, F.least(F.lit(cap), F.coalesce(F.col("level") * w / F.col("total"), F.lit(cap)))).otherwise(0.0)
    return joined.withColumn("capped", share).drop("p", "total", "level")


def scaled_to_groups(rows: DataFrame, limits: dict[str, float], gross: float = 1.0, least: float = 0.001, weight: str = "capped") -> DataFrame:
    """Adds final: weights of a group (a column of `limits`) above its limit are scaled down to it, by the smallest of a
    row's factors; then all to `gross` at most; weights under `least` become 0. A null group counts as one. Sums are
    partial sums of groups, so no group is gathered."""
    out, factors = rows, []
    for k, (column, limit) in enumerate(limits.items()):
        sums = rows.groupBy(F.col(column).alias(f"_g{k}")).agg(F.sum(weight).alias(f"_s{k}"))
        out = out.join(sums, F.col(column).eqNullSafe(F.col(f"_g{k}")), "left")
        factors.append(F.when(F.col(f"_s{k}") > limit, limit / F.col(f"_s{k}")).otherwise(1.0))
    scaled = out.withColumn("final", F.col(weight) * F.least(*factors, F.lit(1.0))).drop(*(c for k in range(len(limits)) for c in (f"_g{k}", f"_s{k}")))
    total = scaled.agg(F.sum("final").alias("_all"))  # one row
    final = F.when(F.col("_all") > gross, F.col("final") * gross / F.col("_all")).otherwise(F.col("final"))
    return scaled.join(total).withColumn("final", final).withColumn("final", F.when(F.col("final") < least, 0.0).otherwise(F.col("final"))).drop("_all")


def turnover(rows: DataFrame, portfolio: str, cost_bps: float = 20.0, least: float = 0.0005) -> DataFrame:
    """rows(portfolio, symbol, before, after) -> by portfolio: half the sum of absolute changes, cost, and how many symbols
    are bought, sold and left as they are; changes under `least` are left out. A missing side is a weight of 0."""
    delta = F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))
    moved = rows.withColumn("d", F.when(F.abs(delta) < least, 0.0).otherwise(delta))
    half = F.sum(F.abs("d")) / 2
    return moved.groupBy(portfolio).agg(half.alias("turnover"), (F.sum(F.abs("d")) * cost_bps / 10_000).alias("cost"), F.count_if(F.col("d") > 0).alias("bought"), F.count_if(F.col("d") < 0).alias("sold"), F.count_if(F.col("d") == 0).alias("kept"))


CAP, SECTOR, STRATEGY, GROSS = 0.013, 0.24, 0.4, 0.95


def _stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights inside each strategy."""
    return POSITIONS.frame(spark, sf_dir).select("symbol", "sector", "strategy", (F.col("weight") / F.sum("weight").over(Window.partitionBy("strategy"))).alias("weight"))


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water_filled(_stakes(spark, sf_dir), CAP, "strategy")


def b11_redistributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir).select("symbol", "strategy", F.round("capped", 9).alias("capped"))


def b11_final_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of each strategy's capped weights, scaled to sectors, strategies and the gross limit."""
    rows = _capped(spark, sf_dir).withColumn("capped", F.col("capped") / 3)
    return scaled_to_groups(rows, {"sector": SECTOR, "strategy": STRATEGY}, GROSS).select("symbol", "strategy", F.round("final", 9).alias("final"))


def b13_limits_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, sectors, strategies and clusters of correlated symbols that weigh more than allowed."""
    rows, limits = POSITIONS.frame(spark, sf_dir), {"symbol": 0.011, "sector": 0.22, "strategy": 0.4, "cluster": 0.02}
    groups = None
    for kind in ("symbol", "sector", "strategy"):
        part = rows.groupBy(F.col(kind).cast("string").alias("name")).agg(F.sum("weight").alias("weight")).select(F.lit(kind).alias("kind"), "name", "weight")
        groups = part if groups is None else groups.unionByName(part)
    clusters = b15_correlation_clusters(spark, sf_dir).select(F.lit("cluster").alias("kind"), F.col("cluster").cast("string").alias("name"), "weight").distinct()
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("kind")]
    over = F.round("weight", 9) - limit
    return groups.unionByName(clusters).select("kind", "name", F.round("weight", 9).alias("weight"), F.round(over, 9).alias("excess")).where("excess > 0")


def b18_turnover_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _capped(spark, sf_dir).select("strategy", "symbol", F.col("weight").alias("before"), F.col("capped").alias("after"))
    return turnover(rows, "strategy").select("strategy", F.round("turnover", 9).alias("turnover"), F.round("cost", 9).alias("cost"), "bought", "sold", "kept")


def b12_net_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long, short, net and gross weight by sector and in all, with the symbol of the largest absolute weight. A symbol is
    short where its returns fall on average."""
    sides = RETURNS.frame(spark, sf_dir).groupBy("symbol").agg(F.when(F.avg("r") < 0.2, -1).otherwise(1).alias("side"))
    rows = POSITIONS.frame(spark, sf_dir).groupBy("symbol", "sector").agg(F.sum("weight").alias("weight")).join(sides, "symbol").withColumn("signed", F.col("side") * F.col("weight"))
    figures = [F.sum(F.when(F.col("signed") > 0, F.col("signed")).otherwise(0.0)), F.sum(F.when(F.col("signed") < 0, -F.col("signed")).otherwise(0.0)), F.sum("signed"), F.sum("weight")]
    top = F.max(F.struct(F.round("weight", 12).alias("w"), (-F.col("symbol")).alias("s")))
    grouped = rows.rollup("sector").agg(*(F.round(f, 9).alias(n) for f, n in zip(figures, ("long", "short", "net", "gross"), strict=True)), top.alias("top"))
    return grouped.select(F.coalesce("sector", F.lit("ALL")).alias("sector"), "long", "short", "net", "gross", (-F.col("top.s")).alias("top_symbol"))


QUERIES = {f.__name__: f for f in (b11_redistributed, b11_final_weights, b13_limits_broken, b18_turnover_cost, b12_net_exposure)}

#: Redistribution step by step: cut at the cap and deal the excess out in proportion, 60 times.
_FILLED = f"""s AS (SELECT symbol, sector, strategy, weight / sum(weight) OVER (PARTITION BY strategy) AS weight FROM ({POSITIONS.sql}) x),
steps AS (
  SELECT symbol, sector, strategy, weight, weight AS c, 0 AS k FROM s UNION ALL
  SELECT symbol, sector, strategy, weight, CASE WHEN c >= {CAP} THEN {CAP} ELSE c + c * excess / nullif(room, 0) END, k + 1 FROM (
    SELECT *, sum(greatest(c - {CAP}, 0)) OVER (PARTITION BY strategy) AS excess, sum(CASE WHEN c < {CAP} THEN c ELSE 0 END) OVER (PARTITION BY strategy) AS room FROM steps) z WHERE k < 60),
f AS (SELECT symbol, sector, strategy, weight, c AS capped FROM steps WHERE k = 60)"""
ORACLES = {
    "b11_redistributed": f"WITH RECURSIVE {_FILLED} SELECT symbol, strategy, round(capped, 9) AS capped FROM f",
    "b11_final_weights": f"WITH RECURSIVE {_FILLED}, g AS (SELECT symbol, strategy, capped / 3 * least(1.0, {SECTOR} / sum(capped / 3) OVER (PARTITION BY sector), {STRATEGY} / sum(capped / 3) OVER (PARTITION BY strategy)) AS v FROM f), h AS (SELECT symbol, strategy, v * least(1.0, {GROSS} / sum(v) OVER ()) AS v FROM g) SELECT symbol, strategy, round(CASE WHEN v < 0.001 THEN 0.0 ELSE v END, 9) AS final FROM h",
    "b13_limits_broken": f"WITH RECURSIVE {_R}, {_P}, {_CLUSTERS}, x AS ({POSITIONS.sql}), y AS (SELECT 'symbol' AS kind, symbol::VARCHAR AS name, sum(weight) AS weight, 0.011 AS most FROM x GROUP BY symbol UNION ALL SELECT 'sector', sector, sum(weight), 0.22 FROM x GROUP BY sector UNION ALL SELECT 'strategy', strategy, sum(weight), 0.4 FROM x GROUP BY strategy UNION ALL SELECT DISTINCT 'cluster', cluster::VARCHAR, weight, 0.02 FROM clusters) SELECT kind, name, round(weight, 9) AS weight, round(round(weight, 9) - most, 9) AS excess FROM y WHERE round(weight, 9) > most",
    "b18_turnover_cost": f"WITH RECURSIVE {_FILLED}, d AS (SELECT strategy, CASE WHEN abs(capped - weight) < 0.0005 THEN 0 ELSE capped - weight END AS d FROM f) SELECT strategy, round(sum(abs(d)) / 2, 9) AS turnover, round(sum(abs(d)) * 0.002, 9) AS cost, count(*) FILTER (d > 0) AS bought, count(*) FILTER (d < 0) AS sold, count(*) FILTER (d = 0) AS kept FROM d GROUP BY strategy",
    "b12_net_exposure": f"WITH p AS (SELECT symbol, sector, sum(weight) AS w FROM ({POSITIONS.sql}) x GROUP BY symbol, sector), m AS (SELECT symbol, avg(r) AS a FROM ({RETURNS.sql}) y GROUP BY symbol), z AS (SELECT p.*, CASE WHEN a < 0.2 THEN -w ELSE w END AS g FROM p JOIN m USING (symbol)) SELECT coalesce(sector, 'ALL') AS sector, round(coalesce(sum(g) FILTER (g > 0), 0), 9) AS long, round(coalesce(-sum(g) FILTER (g < 0), 0), 9) AS short, round(sum(g), 9) AS net, round(sum(w), 9) AS gross, first(symbol ORDER BY round(w, 12) DESC, symbol) AS top_symbol FROM z GROUP BY ROLLUP (sector)",
}
