"""Streaks of losses over a long ordered table, whose groups may be few and large."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.sources.bars import parts
from barloom.sources.tables import TRADES

PIECE = "name string, part int, head long, tail long, whole boolean, n long, total long, most long"


def _pieces(batches):
    """Sorted rows (name, flag) of a part of the table -> by name: the streaks at both ends, one over the whole piece, and
    number, sum and maximum of those inside."""
    part = TaskContext.get().partitionId()
    out, now = [], None
    for batch in batches:
        names, flags = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        codes = names.dictionary_encode()
        code = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        ends = [*(np.flatnonzero(np.diff(code) != 0) + 1), len(code)] if len(code) else []
        at = 0
        for to in ends:
            name = names[at].as_py()
            if now is None or now["name"] != name:
                now = {"name": name, "head": None, "run": 0, "n": 0, "total": 0, "most": 0}
                out.append(now)
            breaks = np.flatnonzero(~flags[at:to])
            if len(breaks):
                first = now["run"] + int(breaks[0])
                inner = np.diff(breaks) - 1
                inner = inner[inner > 0]
                if now["head"] is None:
                    now["head"] = first
                elif first:
                    inner = np.append(inner, first)
                now["n"] += len(inner)
                now["total"] += int(inner.sum())
                now["most"] = max(now["most"], int(inner.max(initial=0)))
                now["run"] = to - at - 1 - int(breaks[-1])
            else:
                now["run"] += to - at
            at = to
    rows = [{"name": p["name"], "part": part, "head": p["head"] or 0, "tail": p["run"], "whole": p["head"] is None, "n": p["n"], "total": p["total"], "most": p["most"]} for p in out]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    yield pa.RecordBatch.from_pylist(rows, pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PIECE.split(", ")]))


def streaks(rows: DataFrame, name: str, flag: str, order: list[str], into: int | None = None) -> DataFrame:
    """By name (a string, null is one, too): worst, the longest run of rows with the flag in the order given, and mean, the
    mean length of all runs; names without a flagged row are left out. The table is sorted as a whole over all tasks, each of
    which hands on a few figures for a name, so that no name is gathered."""
    keys = [F.col("_name"), *map(F.col, order)]
    given = rows.select(F.col(name).cast("string").alias("_name"), F.coalesce(F.col(flag), F.lit(False)).alias("_flag"), *order)
    ranged = given.repartitionByRange(into, *keys) if into else given.repartitionByRange(*keys)
    pieces = ranged.sortWithinPartitions(*keys).select("_name", "_flag").mapInArrow(_pieces, PIECE)
    # Ends of pieces meet those of the next; a break lies before the tail of a piece that is no streak as a whole.
    ends = F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("broken"), F.col("tail").alias("length")))).otherwise(
        F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("broken"), F.col("head").alias("length")), F.struct(F.lit(1).alias("pos"), F.lit(1).alias("broken"), F.col("tail").alias("length")))
    )
    inside = F.array(F.struct("n", "total", "most"))
    both = pieces.withColumns({"ends": ends, "inside": inside})
    by = Window.partitionBy("name").orderBy("part", "pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = both.select("name", "part", F.inline("ends"), "inside").withColumn("run", F.sum("broken").over(by))
    figures = F.when(F.col("pos") == 0, F.col("inside")[0])
    runs = opened.groupBy("name", "run").agg(F.sum("length").alias("length"), F.sum(figures["n"]).alias("n"), F.sum(figures["total"]).alias("total"), F.max(figures["most"]).alias("most"))
    number = F.sum(F.coalesce("n", F.lit(0)) + (F.col("length") > 0).cast("long"))
    summed = runs.groupBy("name").agg(F.greatest(F.max("length"), F.max("most")).alias("worst"), (F.sum(F.col("length") + F.coalesce("total", F.lit(0))) / F.nullif(number, F.lit(0))).alias("mean"))
    return summed.where("worst > 0").withColumnRenamed("name", name)


def we3_loss_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks of trades that lose after costs, by strategy."""
    trades = TRADES.frame(spark, sf_dir).withColumn("net", F.col("gross_return") - F.col("cost_rate")).withColumn("loss", F.col("net") < 0)
    found = streaks(trades, "strategy", "loss", ["trade_id", "symbol", "notional", "net"], parts(spark, sf_dir))
    return found.select("strategy", "worst", F.round("mean", 6).alias("mean_streak"))


QUERIES = {"we3_loss_streaks": we3_loss_streaks}
#: The statement in `performance.py` is its check.
ORACLES: dict[str, str] = {}
