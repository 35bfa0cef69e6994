"""Training tables, models, bootstrap, sparse bins, first exits and entity links."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.clusters import written
from barloom.plans.layers import Plan, clip, lag, lead, roll
from barloom.sources.bars import BARS, read
from barloom.sources.files import checksum
from barloom.sources.tables import OUTCOMES, RETURNS

FEATURES = ["ret_1", "ret_5", "distance", "volume_ratio"]
CUT = "1999-06-30"


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features at the close, the label ahead, and the part by time: symbol, ts, FEATURES, label, part. Returns are
    clipped, as the proxy prices jump; the label is the only column that looks ahead."""
    plan = Plan(BARS, (
        {"ret_1": clip(f"close / nullif({lag('close')}, 0) - 1", -1, 1), "ret_5": clip(f"close / nullif({lag('close', 5)}, 0) - 1", -1, 1), "m": roll("avg", "close", 20), "v": roll("avg", "volume", 20), "ahead": f"{lead('close', 1)} / nullif(close, 0) - 1"},
        {"distance": clip("close / nullif(m, 0) - 1", -1, 1), "volume_ratio": "volume / nullif(v, 0)", "label": "CASE WHEN ahead > 0 THEN 1.0 WHEN ahead IS NOT NULL THEN 0.0 END", "part": f"CASE WHEN ts < DATE '{CUT}' THEN 'train' ELSE 'test' END"},
    ))
    return plan.frame(spark, sf_dir).where("label is not null").select("symbol", "ts", *FEATURES, "label", "part")


def fitted(train: DataFrame) -> PipelineModel:
    """Imputer, scaler and logistic regression, all fitted on the training rows alone."""
    filled = [f"{c}_filled" for c in FEATURES]
    return Pipeline(stages=[
        Imputer(inputCols=FEATURES, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=20, regParam=0.01),
    ]).fit(train)


def m01_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_table(spark, sf_dir).groupBy("part", F.col("label").cast("double").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("distance").isNull()).alias("missing"))


def trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PipelineModel]:
    """The training table, written once for all the passes over it, and the model of its training part."""
    rows = written(training_table(spark, sf_dir), "training")
    return rows, fitted(rows.where("part = 'train'"))


def m06_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the past, score the rest: symbol, ts, label, score."""
    rows, model = trained(spark, sf_dir)
    return model.transform(rows.where("part = 'test'")).select("symbol", "ts", "label", F.round(vector_to_array("probability")[1], 6).alias("score"))


def aligned(df: DataFrame, features: list[str], keys: tuple[str, ...] = (), extra: bool = True, missing: bool = False) -> DataFrame:
    """The keys and then exactly the model's features, in its order and as doubles. Columns that the model does not know go,
    or are refused without `extra`; features that the table lacks are refused, or null with `missing`."""
    if not features or len(set(features)) < len(features):
        raise ValueError(f"features must be some and distinct: {features}")
    lacking, more = [c for c in features if c not in df.columns], sorted(set(df.columns) - {*features, *keys})
    if lacking and not missing:
        raise ValueError(f"features that the table lacks: {lacking}")
    if more and not extra:
        raise ValueError(f"columns that the model does not know: {more}")
    return df.select(*keys, *((F.lit(None) if c in lacking else F.col(f"`{c}`").try_cast("double")).cast("double").alias(c) for c in features))


def inferred(model, df: DataFrame, features: list[str], keys: tuple[str, ...], **rules) -> DataFrame:
    """keys, prediction, score and the number of features that were null and so filled as in training."""
    scored = model.transform(aligned(df, features, keys, **rules))
    holes = sum((F.col(c).isNull().cast("int") for c in features), F.lit(0))
    return scored.select(*keys, F.col("prediction").cast("int").alias("prediction"), F.round(vector_to_array("probability")[1], 6).alias("score"), holes.alias("filled"))


def m08_batch_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows behind the cut scored from a table with text instead of numbers, another order and a column too many."""
    rows, model = trained(spark, sf_dir)
    foreign = rows.where("part = 'test'").select("symbol", "ts", "part", *(F.col(c).cast("string").alias(c) for c in reversed(FEATURES)))
    return inferred(model, foreign, FEATURES, ("symbol", "ts"))


def m09_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of accuracy when a feature's values are moved to the row that follows in hash order, within a symbol."""
    rows, model = trained(spark, sf_dir)
    moved = lambda c: F.lead(c).over(W.partitionBy("symbol").orderBy(F.xxhash64(F.lit(c), "ts"))).alias(f"moved_{c}")
    test = rows.where("part = 'test'").select("label", *FEATURES, *map(moved, FEATURES))  # one shuffle for all
    variant = lambda name: F.struct(F.lit(name).alias("feature"), *(F.col(f"moved_{c}" if c == name else c).alias(c) for c in FEATURES))
    variants = test.select("label", F.inline(F.array(*map(variant, ["none", *FEATURES]))))
    return model.transform(variants).groupBy("feature").agg(F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"))


def b25_bootstrap(spark: SparkSession, sf_dir: str, simulations: int = 50, steps: int = 60, block: int = 5) -> DataFrame:
    """Interval of the mean return of each symbol by a block bootstrap. The draw of a step is a hash of seed, symbol,
    simulation and block, so a task that runs again draws the same."""
    w = W.partitionBy("symbol").orderBy("ts")
    rows = RETURNS.frame(spark, sf_dir).select("symbol", "r", (F.row_number().over(w) - 1).alias("k"), F.count("*").over(W.partitionBy("symbol")).alias("n"))
    sizes = rows.groupBy("symbol").agg(F.max("n").alias("n"))
    grid = sizes.select("symbol", "n", F.explode(F.sequence(F.lit(1), F.lit(simulations))).alias("sim")).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    drawn = grid.withColumn("k", F.pmod(F.pmod(F.xxhash64(F.lit(7), "symbol", "sim", F.floor(F.col("step") / block)), "n") + F.col("step") % block, "n").cast("int"))
    means = drawn.join(rows.select("symbol", "k", "r"), ["symbol", "k"]).groupBy("symbol", "sim").agg(F.avg("r").alias("m"))
    return means.groupBy("symbol").agg(F.round(F.percentile("m", F.lit(0.05)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.95)), 6).alias("high"))


def c03_merged_bins(spark: SparkSession, sf_dir: str, least: int = 60) -> DataFrame:
    """Neighbouring score bins merged until each holds `least` rows, a sparse tail joins the bin before: a fold over the
    ten bins of a strategy."""
    bins = OUTCOMES.frame(spark, sf_dir).groupBy("strategy", F.least(F.floor(F.col("score") / 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    kind = "array<struct<low: int, high: int, n: bigint, hits: bigint>>"
    item = lambda a, b: F.struct(a["low"].alias("low"), b["high"].alias("high"), (a["n"] + b["n"]).alias("n"), (a["hits"] + b["hits"]).alias("hits"))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    start = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    add = lambda a, x: F.when((F.size(a) > 0) & (last(a)["n"] < least), F.concat(start(a), F.array(item(last(a), x)))).otherwise(F.concat(a, F.array(x)))
    folded = bins.groupBy("strategy").agg(F.sort_array(F.collect_list(F.struct(F.col("bin").alias("low"), F.col("bin").alias("high"), "n", "hits"))).cast(kind).alias("bins")).select("strategy", F.aggregate("bins", F.array().cast(kind), add).alias("b"))
    tail = F.when((F.size("b") > 1) & (last(F.col("b"))["n"] < least), F.concat(start(start(F.col("b"))), F.array(item(F.element_at("b", -2), F.element_at("b", -1))))).otherwise(F.col("b"))
    return folded.select("strategy", F.explode(tail).alias("x")).select("strategy", "x.low", "x.high", "x.n", F.round(F.col("x.hits") / F.col("x.n"), 6).alias("rate"))


def x04_first_exit(spark: SparkSession, sf_dir: str, target: float = 0.1, stop: float = -0.1, bars: int = 20) -> DataFrame:
    """For an entry at each bar of a symbol (number k0): the first of the `bars` bars behind it that hits the target or
    the stop, or the last of them. Entries without a hit whose time limit lies behind the last bar are still open: no row."""
    w = W.partitionBy("symbol").orderBy("ts")
    ahead = [F.lead("close", i).over(w).alias(f"c{i}") for i in range(1, bars + 1)]
    rows = BARS.frame(spark, sf_dir).select("symbol", F.col("close").alias("c0"), F.row_number().over(w).alias("k0"), F.count("*").over(w.rowsBetween(1, bars)).alias("n_ahead"), *ahead)
    exit_of = lambda rule, i: F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("bars_held"))
    move = lambda i: F.try_divide(f"c{i}", "c0") - 1
    hits = [F.when(move(i) >= target, exit_of("TARGET", i)).when(move(i) <= stop, exit_of("STOP", i)) for i in range(1, bars + 1)]
    found = F.coalesce(*hits, F.when(F.col("n_ahead") == bars, exit_of("TIME", bars)))
    return rows.select("symbol", "k0", found.alias("x")).where("x is not null").select("symbol", "k0", "x.rule", "x.bars_held")


def f12_f13_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of the form mailN and versions found in texts, with the number of documents that hold them: a small part of
    F12 and F13. Dates, events and links to instruments are open."""
    text = F.col("text")
    found = F.array_union(F.regexp_extract_all(text, F.lit(r"@(mail[0-9]+)\."), F.lit(1)), F.regexp_extract_all(text, F.lit(r"[Vv]ersion ([0-9](?:\.[0-9])?)"), F.lit(1)))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("entity")).groupBy("entity").agg(F.count_distinct("doc_id").alias("n"))


def s14_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum(read(spark, sf_dir, "orders"))


QUERIES = {f.__name__: f for f in (m01_dataset, m06_scored, m08_batch_inference, m09_permutation, b25_bootstrap, c03_merged_bins, x04_first_exit, f12_f13_entities, s14_checksum)}

# Written apart from the queries: joins on a bar's number and recursion in place of windows and folds.
_HIT = "b.close / nullif(a.close, 0) - 1"
ORACLES = {
    "m01_dataset": f"WITH b AS (SELECT ts, close, row_number() OVER w AS k, lead(close) OVER w AS following FROM ({BARS.sql}) WINDOW w AS (PARTITION BY symbol ORDER BY ts)) SELECT CASE WHEN ts < DATE '{CUT}' THEN 'train' ELSE 'test' END AS part, CAST(following > close AS INT)::DOUBLE AS label, count(*) AS n, count(*) FILTER (k < 20) AS missing FROM b WHERE following IS NOT NULL AND close <> 0 GROUP BY ALL",
    "c03_merged_bins": f"WITH RECURSIVE h AS (SELECT strategy, CAST(least(floor(score / 10), 9) AS INT) AS bin, count(*) AS n, sum(hit) AS hits FROM ({OUTCOMES.sql}) GROUP BY ALL), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY bin) AS k FROM h), r AS (SELECT strategy, k, 1 AS g, n AS held FROM o WHERE k = 1 UNION ALL SELECT o.strategy, o.k, CASE WHEN r.held < 60 THEN r.g ELSE r.g + 1 END, CASE WHEN r.held < 60 THEN r.held + o.n ELSE o.n END FROM r JOIN o ON o.strategy = r.strategy AND o.k = r.k + 1), e AS (SELECT strategy, g, min(bin) AS low, max(bin) AS high, sum(n) AS n, sum(hits) AS hits, max(g) OVER (PARTITION BY strategy) AS top FROM o JOIN r USING (strategy, k) GROUP BY strategy, g) SELECT strategy, min(low) AS low, max(high) AS high, CAST(sum(n) AS BIGINT) AS n, round(sum(hits) / sum(n), 6) AS rate FROM e GROUP BY strategy, CASE WHEN g = top AND g > 1 AND n < 60 THEN g - 1 ELSE g END",
    "x04_first_exit": f"WITH b AS MATERIALIZED (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM ({BARS.sql})), s AS (SELECT symbol, close, k, unnest(range(1, 21)) AS held FROM b), h AS (SELECT a.symbol, a.k, a.held, CASE WHEN {_HIT} >= 0.1 THEN 'TARGET' WHEN {_HIT} <= -0.1 THEN 'STOP' WHEN a.held = 20 THEN 'TIME' END AS rule FROM s a JOIN b ON b.symbol = a.symbol AND b.k = a.k + a.held) SELECT symbol, CAST(k AS INT) AS k0, arg_min(rule, held) AS rule, CAST(min(held) AS INT) AS bars_held FROM h WHERE rule IS NOT NULL GROUP BY symbol, k",
}
