"""Clusters of symbols whose returns move together."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.performance import _STAKES
from barloom.plans.statements import Statement
from barloom.sources.tables import POSITIONS

WEIGHTS = Statement(f"SELECT symbol, sum(weight) AS weight FROM ({_STAKES}) s GROUP BY symbol", {"positions": POSITIONS})


def _folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; local mode without that setting takes a temporary one."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not named and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df by a checkpoint in the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, smaller than a checkpoint and read by columns."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def linked_groups(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """links(a, b) -> (node, least): the smallest node reachable from each linked one. Each round takes the smallest label
    around a node and then that label's own label, so the rounds grow with the logarithm of a group's length."""
    edges = links.where("a <> b").select("a", "b")
    edges = kept(edges.union(edges.select("b", "a")).distinct())
    labels = kept(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("least")))
    for _ in range(max_rounds):
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("least").alias("low"))
        nearer = labels.join(around, labels["node"] == around["a"]).select("node", "least", F.least("least", "low").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("least").alias("far"))
        moved = kept(nearer.join(jump, "next").select("node", F.col("least").alias("old"), F.least("next", "far").alias("least")))
        labels = moved.select("node", "least")
        if not moved.where("old <> least").take(1):
            return labels
    raise RuntimeError(f"groups: not settled after {max_rounds} rounds")


def correlation_clusters(pairs: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """pairs(a, b, correlation), weights(symbol, weight) -> cluster, symbol, symbols, weight of the cluster. Symbols belong
    together over any chain of pairs with an absolute correlation of at least `threshold`, so no order of symbols matters;
    a cluster is named by its smallest symbol, and symbols without a pair are in none."""
    return linked_clusters(pairs.where(F.abs("correlation") >= threshold), weights)


def linked_clusters(links: DataFrame, weights: DataFrame) -> DataFrame:
    """links(a, b) of symbols that belong together -> the same."""
    groups = linked_groups(links).withColumnsRenamed({"node": "symbol", "least": "cluster"})
    staked = groups.join(weights, "symbol", "left")
    sizes = staked.groupBy("cluster").agg(F.count("*").alias("symbols"), F.round(F.sum(F.coalesce("weight", F.lit(0.0))), 9).alias("weight"))
    return groups.join(sizes, "cluster").select("cluster", "symbol", "symbols", "weight")


THRESHOLD = 0.3
