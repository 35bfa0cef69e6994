"""Block bootstrap of whole paths: each simulated path is folded into its end, its deepest loss and its ruin.

The draw of a block is a hash of seed, series, simulation and block, so a task that runs again draws the same. A path is a
group of `steps` rows; the rows of a series are met by their numbers, so no series is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.sources.tables import RETURNS

SEED, SIMULATIONS, STEPS, BLOCK = 7, 60, 40, 5
RUIN, DEEP, TAIL = 0.5, 0.6, 0.05  #: share of the start that is ruin, loss from the peak that is deep, part of the paths in the tail


def _start(n: Column, block: Column, seed: int) -> Column:
    """First row of a block: the leading 32 bits of an md5, modulo the rows of the series."""
    text = F.concat_ws(":", F.lit(seed), F.col("symbol"), F.col("sim"), block)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def bootstrap_paths(rows: DataFrame, simulations: int = SIMULATIONS, steps: int = STEPS, block: int = BLOCK, seed: int = SEED, ruin: float = RUIN) -> DataFrame:
    """rows(symbol, ts, r) -> (symbol, sim, log_end, drawdown, ruined): the logarithm of the final equity (from 1), the
    largest loss from a peak as a share of it, and whether equity fell to `ruin` or below. Returns are drawn in blocks of
    `block` neighbours that wrap around the end. Null returns are left out; a return of -1 or less ends a path at nothing."""
    w = Window.partitionBy("symbol")
    own = rows.where("r is not null").select("symbol", F.col("r").cast("double").alias("r"), (F.row_number().over(w.orderBy("ts")) - 1).alias("k"))
    sizes = own.groupBy("symbol").agg(F.count("*").alias("n"))
    blocks = sizes.select("symbol", "n", F.explode(F.sequence(F.lit(1), F.lit(simulations))).alias("sim")).select("*", F.explode(F.sequence(F.lit(0), F.lit((steps - 1) // block))).alias("b"))
    drawn = blocks.withColumn("at", _start(F.col("n"), F.col("b"), seed)).select("symbol", "n", "sim", "b", "at", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("i"))
    drawn = drawn.select("symbol", "sim", (F.col("b") * block + F.col("i")).alias("step"), ((F.col("at") + F.col("i")) % F.col("n")).cast("int").alias("k")).where(F.col("step") < steps)
    paths = drawn.join(own, ["symbol", "k"]).groupBy("symbol", "sim").agg(F.sort_array(F.collect_list(F.struct("step", "r"))).alias("path"))

    def move(s: Column, x: Column) -> Column:
        equity = s["equity"] * F.greatest(1 + x["r"], F.lit(0.0))
        peak = F.greatest(s["peak"], equity)
        return F.struct(equity.alias("equity"), peak.alias("peak"), F.greatest(s["down"], 1 - equity / peak).alias("down"), F.least(s["low"], equity).alias("low"))

    start = F.struct(F.lit(1.0).alias("equity"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("down"), F.lit(1.0).alias("low"))
    end = paths.select("symbol", "sim", F.aggregate("path", start, move).alias("end"))
    return end.select("symbol", "sim", F.ln("end.equity").alias("log_end"), F.col("end.down").alias("drawdown"), (F.col("end.low") <= ruin).alias("ruined"))


def path_intervals(paths: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Intervals of total return (as a logarithm), mean return of a step and drawdown by symbol."""
    at = lambda c, p: F.round(F.percentile(c, F.lit(p)), 6)
    return paths.groupBy("symbol").agg(at("log_end", low).alias("return_low"), at("log_end", 0.5).alias("return_mid"), at("log_end", high).alias("return_high"), at("drawdown", 0.5).alias("drawdown_mid"), at("drawdown", high).alias("drawdown_high"))


def tail_figures(paths: DataFrame, observed: DataFrame, deep: float = DEEP, tail: float = TAIL) -> DataFrame:
    """By symbol: chances of loss, of a drawdown above `deep` and of ruin, the mean loss of the worst `tail` of the paths (at
    least one), and where the observed logarithm lies among them: mid-rank and the share of paths that reach it. A path
    that ends at nothing has no logarithm and counts as a loss of all."""
    end = F.coalesce(F.exp("log_end"), F.lit(0.0))
    ranked = paths.withColumns({"end": end, "k": F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("log_end").asc_nulls_first(), "sim")), "n": F.count("*").over(Window.partitionBy("symbol"))})
    worst = F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * tail))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    mine = F.col("observed")
    path = F.coalesce("log_end", F.lit(float("-inf")))
    rank = F.avg(F.when(path < mine - 1e-9, 1.0).when(path <= mine + 1e-9, 0.5).otherwise(0.0))
    return ranked.join(observed, "symbol").groupBy("symbol").agg(
        share(F.col("end") < 1).alias("p_loss"), share(F.col("drawdown") > deep).alias("p_deep"), share(F.col("ruined")).alias("p_ruin"), F.round(F.avg(F.when(worst, F.col("end") - 1)), 6).alias("cvar"),
        F.round(rank, 6).alias("mid_rank"), share(path >= mine - 1e-9).alias("p_value"),
    )


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RETURNS.frame(spark, sf_dir).select("symbol", "ts", "r")


def b25_path_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_intervals(bootstrap_paths(_rows(spark, sf_dir)))


def b26_path_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed path is made of the newest returns of a symbol, as many as a simulated one has."""
    rows = _rows(spark, sf_dir)
    newest = rows.where("r is not null").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("k") <= STEPS)
    return tail_figures(bootstrap_paths(rows), newest.groupBy("symbol").agg(F.sum(F.ln(F.greatest(1 + F.col("r"), F.lit(1e-300)))).alias("observed")))


QUERIES = {f.__name__: f for f in (b25_path_bootstrap, b26_path_tails)}
#: Paths as running sums of logarithms in windows.
_PATHS = f"""x AS MATERIALIZED (SELECT symbol, ts, r, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM ({RETURNS.sql}) y WHERE r IS NOT NULL),
g AS (SELECT symbol, n, sim, step FROM (SELECT DISTINCT symbol, n FROM x) s, range(1, {SIMULATIONS + 1}) a(sim), range({STEPS}) b(step)),
d AS (SELECT symbol, sim, step, (('0x' || substr(md5(concat_ws(':', {SEED}, symbol, sim, step // {BLOCK})), 1, 8))::BIGINT % n + step % {BLOCK}) % n AS k FROM g),
l AS (SELECT d.symbol, d.sim, d.step, sum(ln(1 + x.r)) OVER (PARTITION BY d.symbol, d.sim ORDER BY d.step) AS le FROM d JOIN x ON x.symbol = d.symbol AND x.k = d.k),
m AS (SELECT *, greatest(0, max(le) OVER (PARTITION BY symbol, sim ORDER BY step)) AS top FROM l),
paths AS (SELECT symbol, sim, arg_max(le, step) AS log_end, max(1 - exp(le - top)) AS drawdown, min(le) <= ln({RUIN}) AS ruined FROM m GROUP BY symbol, sim)"""
_AT = lambda c, p: f"round(quantile_cont({c}, {p}), 6)"
ORACLES = {
    "b25_path_bootstrap": f"WITH {_PATHS} SELECT symbol, {_AT('log_end', 0.05)} AS return_low, {_AT('log_end', 0.5)} AS return_mid, {_AT('log_end', 0.95)} AS return_high, {_AT('drawdown', 0.5)} AS drawdown_mid, {_AT('drawdown', 0.95)} AS drawdown_high FROM paths GROUP BY symbol",
    "b26_path_tails": f"""WITH {_PATHS}, o AS (SELECT symbol, sum(ln(1 + r)) AS observed FROM x WHERE k >= n - {STEPS} GROUP BY symbol),
r AS (SELECT p.*, observed, row_number() OVER (PARTITION BY p.symbol ORDER BY log_end, sim) <= greatest(1, floor({SIMULATIONS} * {TAIL})) AS worst FROM paths p JOIN o ON o.symbol = p.symbol)
SELECT symbol, round(avg((log_end < 0)::INT), 6) AS p_loss, round(avg((drawdown > {DEEP})::INT), 6) AS p_deep, round(avg(ruined::INT), 6) AS p_ruin, round(avg(exp(log_end) - 1) FILTER (worst), 6) AS cvar,
  round(avg(CASE WHEN log_end < observed - 1e-9 THEN 1 WHEN log_end <= observed + 1e-9 THEN 0.5 ELSE 0 END), 6) AS mid_rank, round(avg((log_end >= observed - 1e-9)::INT), 6) AS p_value FROM r GROUP BY symbol""",
}
