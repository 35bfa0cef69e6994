"""Correlation of all pairs of series as a product of blocks.

Series are dealt to blocks by hash, days to runs of DAYS. A tile holds the values of one block in one run of days as bytes.
Tiles are written once, by block, and a task of a Cartesian product reads those of two blocks and multiplies them, run by
run, into sums over the days that two series share. So what is shuffled and written is the rows once, whatever the number
of blocks; only the products are quadratic, and where pairs are not the result they are summed up in the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators.clusters import THRESHOLD, WEIGHTS, kept, linked_clusters, linked_groups, written
from barloom.sources.tables import POSITIONS, RETURNS

BLOCK, DAYS, PARTS = 1024, 256, 64  #: series of a block, about; days of a tile; partitions of tiles at most
PAIR = "a long, b long, n long, correlation double"
LINK = "a long, b long"
WHOLE = "pairs long, total double"
WEIGHTED = "symbol long, most double, product double, weight double"
TILE = "block int, run int, members binary, weights binary, day binary, slot binary, z binary"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in schema.split(", ")])


def _packed(batches):
    """Rows by block and run, the series of a block (run -1: mean as r, deviation, weight) first -> its tiles."""
    block, members, held = None, None, []

    def tile():
        symbol, day, r = (np.concatenate([h[c] for h in held]) for c in ("symbol", "day", "r"))
        slot = np.minimum(np.searchsorted(members["symbol"], symbol), len(members["symbol"]) - 1)
        moves = members["symbol"][slot] == symbol
        slot, day = slot[moves], (day[moves] % DAYS).astype(np.uint8)
        z = (r[moves] - members["r"][slot]) / members["deviation"][slot]
        parts = members["symbol"], members["weight"], day, slot.astype(np.uint16), z
        return _batch(TILE, np.array([block], np.int32), np.array([run], np.int32), *([p.tobytes()] for p in parts))

    run = None
    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        ends = np.flatnonzero((np.diff(rows["block"]) != 0) | (np.diff(rows["run"]) != 0)) + 1
        for at, to in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            if at == to:
                continue
            part = {c: v[at:to] for c, v in rows.items()}
            if (part["block"][0], part["run"][0]) != (block, run):
                if held and run == -1:
                    members = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                elif held and members is not None:
                    yield tile()
                if part["block"][0] != block:
                    members = None
                block, run, held = part["block"][0], part["run"][0], []
            held.append(part)
    if held and run != -1 and members is not None:
        yield tile()


def _pairs(least: int, threshold: float | None, schema: str):
    """Pairs of tiles of two blocks, by the first block and run -> rows of the schema, once all runs of both are summed."""

    def matrix(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
        days, slots = np.frombuffer(row[f"day{side}"], np.uint8), np.frombuffer(row[f"slot{side}"], np.uint16)
        values = np.zeros((DAYS, len(row[f"members{side}"]) // 8))
        there = np.zeros_like(values)
        values[days, slots], there[days, slots] = np.frombuffer(row[f"z{side}"]), 1.0
        return values, there

    def found(of: dict, same: bool) -> pa.RecordBatch:
        n, x, y, xx, yy, xy = of["sums"]
        with np.errstate(all="ignore"):
            over = (n * xx - x * x) * (n * yy - y * y)
            c = np.clip(np.where(over > 0, (n * xy - x * y) / np.sqrt(over), np.nan), -1, 1)
        keep = (n >= least) & np.isfinite(c)
        if threshold is not None:
            keep &= np.abs(c) >= threshold
        left, right = of["names"]
        if schema == WEIGHTED:
            return weighted(of, np.where(keep & ~np.eye(*keep.shape, dtype=bool) if same else keep, c, np.nan), same)
        if same:
            keep = np.triu(keep, 1)
        i, j = np.nonzero(keep)
        if schema == WHOLE:
            return _batch(WHOLE, [len(i)], [float(c[i, j].sum())])
        if schema == LINK:
            return _batch(LINK, *spanned(left, right, i, j))
        return _batch(PAIR, np.minimum(left[i], right[j]), np.maximum(left[i], right[j]), n[i, j].astype(np.int64), c[i, j])

    def spanned(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every linked symbol with the smallest one that it reaches in these two blocks: at most one link of a symbol."""
        symbols, ends = np.unique(np.concatenate([left[i], right[j]]), return_inverse=True)
        one, other = ends[: len(i)], ends[len(i) :]
        label, before = np.arange(len(symbols)), None
        while before is None or (label != before).any():
            before = label.copy()
            np.minimum.at(label, one, before[other])
            np.minimum.at(label, other, before[one])
            label = label[label]
        linked = label != np.arange(len(symbols))
        return symbols[label[linked]], symbols[linked]

    def weighted(of: dict, c: np.ndarray, same: bool) -> pa.RecordBatch:
        """By symbol: the greatest correlation and its sums by the weights of the others; those without a weight are left out."""
        own, theirs = of["weights"]
        c = np.where(np.isfinite(own)[:, None] & np.isfinite(theirs)[None, :], c, np.nan)
        there, zero, parts = np.isfinite(c), np.nan_to_num(c), []
        sides = [(of["names"][0], own, theirs, c, zero, there)]
        if not same:
            sides.append((of["names"][1], theirs, own, c.T, zero.T, there.T))
        for names, of_own, others, corr, filled, has in sides:
            any_, w = has.any(axis=1), np.nan_to_num(others)
            parts.append((names[any_], np.where(has, corr, -np.inf).max(axis=1)[any_] if has.size else np.zeros(0), (filled @ w)[any_], (has @ w)[any_], of_own[any_]))
        symbol, most, product, weight, stake = (np.concatenate(p) for p in zip(*parts, strict=True))
        if len(symbol):  # the whole: by the product of both weights
            symbol, most, product, weight = np.append(symbol, -1), np.append(most, most.max()), np.append(product, stake @ product), np.append(weight, stake @ weight)
        return _batch(WEIGHTED, symbol, most, product, weight)

    def run(batches):
        first, open_ = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() if c in ("block", "block2") else batch.column(c)[k].as_buffer() for c in batch.schema.names}
                if row["block"] != first:
                    for j, of in open_.items():
                        yield found(of, j == first)
                    first, open_ = row["block"], {}
                row = {c: memoryview(v) if c not in ("block", "block2") else v for c, v in row.items()}
                (v, m), (w, o) = matrix(row, ""), matrix(row, "2")
                of = open_.get(row["block2"])
                if of is None:
                    names = [np.frombuffer(bytes(row[c])).view(np.int64) for c in ("members", "members2")]
                    weights = [np.frombuffer(bytes(row[c])) for c in ("weights", "weights2")]
                    of = open_[row["block2"]] = {"names": names, "weights": weights, "sums": np.zeros((6, v.shape[1], w.shape[1]))}
                for at, (a, b) in enumerate(((m, o), (v, o), (m, w), (v * v, o), (m, w * w), (v, w))):
                    of["sums"][at] += a.T @ b
        for j, of in open_.items():
            yield found(of, j == first)

    return run


def _written(rows: DataFrame) -> DataFrame:
    """rows(symbol, ts, r) -> symbol, day, r where both are there, worked out once."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    return kept(rows.where("symbol is not null and r is not null").select(F.col("symbol").cast("long").alias("symbol"), day.alias("day"), F.col("r").cast("double").alias("r")))


def _series(rows: DataFrame, least: int) -> DataFrame:
    """symbol, mean as r and deviation of the series that move and have days enough for a pair."""
    of = rows.groupBy("symbol").agg(F.avg("r").alias("r"), F.stddev_pop("r").alias("deviation"), F.count("r").alias("n"))
    return kept(of.where((F.col("deviation") > 0) & (F.col("n") >= least)).drop("n"))


def _tiles(rows: DataFrame, series: DataFrame, block: int, weights: DataFrame | None = None, aside: bool = False) -> tuple[DataFrame, int]:
    """Tiles of the series, written once, and how many blocks they are. Values are standardised by their own series, so that sums of squares keep
    their digits. Blocks that stand aside are numbered below 0."""
    blocks = max(1, -(-series.count() // block))
    place = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    place = (-1 - place if aside else place).alias("block")
    if weights is None:
        weights = series.select("symbol").limit(0).withColumn("weight", F.lit(0.0))
    nothing = F.lit(float("nan"))
    heads = series.join(weights, "symbol", "left").select(place, F.lit(-1).alias("run"), "symbol", F.lit(0).alias("day"), "r", "deviation", F.coalesce(F.col("weight").cast("double"), nothing).alias("weight"))
    cells = rows.select(place, F.floor(F.col("day") / DAYS).cast("int").alias("run"), "symbol", "day", "r", nothing.alias("deviation"), nothing.alias("weight"))
    # Runs before 1970 are negative, too; those of the heads stand first.
    cells = cells.withColumn("run", F.when(F.col("run") < 0, F.col("run") - 1).otherwise(F.col("run")))
    dealt = heads.unionByName(cells).repartition(min(blocks, PARTS), "block").sortWithinPartitions("block", F.col("run") != -1, "run", "symbol")
    return kept(dealt.mapInArrow(_packed, TILE)), blocks


def _met(tiles: DataFrame, others: DataFrame, once: bool = True) -> DataFrame:
    """Each two partitions of written tiles are one task; nothing is shuffled. A task holds the sums of one block of `tiles` with all blocks of
    a partition of `others`. once: both are the same tiles, and two blocks meet once."""
    others = others.select(*(F.col(c).alias(f"{c}2") for c in others.columns))
    met = (F.col("run") == F.col("run2")) & (F.col("block") <= F.col("block2")) if once else F.col("run") == F.col("run2")
    return tiles.hint("SHUFFLE_REPLICATE_NL").join(others, met).drop("run", "run2")


def _multiplied(rows: DataFrame, least: int, threshold: float | None, block: int, schema: str, weights: DataFrame | None = None) -> DataFrame:
    """rows of `_written` -> rows of the schema from every two blocks. Null values are days without a value."""
    tiles, _ = _tiles(rows, _series(rows, least), block, weights)
    return _met(tiles, tiles).mapInArrow(_pairs(least, threshold, schema), schema)


def pair_correlations(rows: DataFrame, least: int = 30, threshold: float | None = None, block: int = BLOCK) -> DataFrame:
    """rows(symbol, ts, r), one for each symbol and day -> (a, b, n, correlation) of every pair a < b with at least `least`
    days in common and, where given, an absolute correlation of at least `threshold`. A series that does not move over the
    common days has no correlation. An empty table gives no pairs."""
    return _multiplied(_written(rows), least, threshold, block, PAIR)


def linked_symbols(rows: DataFrame, least: int, threshold: float, block: int = BLOCK) -> DataFrame:
    """links(a, b) that join the same symbols to groups as all pairs of at least `threshold` do, so as many links as symbols
    and not as pairs.

    Pairs inside a group cannot change it. So each block meets itself and the first one, and after that only the symbols
    outside the largest group meet further blocks, more in each round, until they have met all. They are what the work grows
    with; where they do not fall below half, all blocks meet."""
    rows = _written(rows)
    series, linked = _series(rows, least), _pairs(least, threshold, LINK)
    tiles, blocks = _tiles(rows, series, block)
    if blocks <= 2:
        return _met(tiles, tiles).mapInArrow(linked, LINK)
    within = tiles.select(*(c for c in tiles.columns if c != "run"), *(F.col(c).alias(f"{c}2") for c in tiles.columns if c != "run"))
    first = kept(tiles.where("block = 0").coalesce(1))
    links = within.mapInArrow(linked, LINK).union(_met(tiles.where("block > 0"), first, False).mapInArrow(linked, LINK))
    symbols, root, met, outside = series.count(), None, 1, series.select("symbol")
    while True:
        groups = linked_groups(links)
        links = groups.select(F.col("least").alias("a"), F.col("node").alias("b"))
        if met == blocks:
            return links
        if root is None:
            largest = groups.groupBy("least").count().orderBy(F.desc("count"), "least").first()
            root = largest["least"] if largest else -1
        else:  # the group of the first round may have got a smaller symbol
            root = groups.where(F.col("node") == root).agg(F.coalesce(F.max("least"), F.lit(root)).alias("root")).first()["root"]
        inside = groups.where(F.col("least") == root).select(F.col("node").alias("symbol"))
        outside = kept(outside.join(inside, "symbol", "left_anti"))
        left = outside.count()
        if not left:
            return links
        if met > 1 and 2 * left > symbols:
            return _met(tiles, tiles).mapInArrow(linked, LINK)
        rows = written(rows.join(outside, "symbol"), "outside")
        until = min(blocks, 4 * met + 1)
        asked, _ = _tiles(rows, series.join(outside, "symbol"), block, aside=True)
        links = links.union(_met(tiles.where(F.col("block").between(met, until - 1)), asked, False).mapInArrow(linked, LINK))
        met = until


def weighted_correlations(rows: DataFrame, weights: DataFrame, least: int = 30, block: int = BLOCK) -> DataFrame:
    """For each symbol of weights(symbol, weight) the greatest correlation to another one and the mean to all others by
    their weights; in all (symbol -1), the mean over pairs by the product of the weights."""
    found = _multiplied(_written(rows), least, None, block, WEIGHTED, weights).groupBy("symbol").agg(F.max("most").alias("most"), F.try_divide(F.sum("product"), F.sum("weight")).alias("mean"))
    whole = found.sparkSession.createDataFrame([(-1,)], "symbol long")
    return found.join(whole, "symbol", "full")


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The newest n rows of each symbol."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_k") <= n).drop("_k")


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RETURNS.frame(spark, sf_dir).select("symbol", "ts", "r").where("r is not null")


def b14_correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_correlations(_returns(spark, sf_dir)).withColumn("correlation", F.round("correlation", 6))


def j11_pair_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the newest 400 returns of each symbol."""
    return pair_correlations(newest(_returns(spark, sf_dir), 400), 20).select("a", "b", "n", F.round("correlation", 6).alias("c"))


def b15_correlation_clusters(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    return linked_clusters(linked_symbols(_returns(spark, sf_dir), 30, threshold), WEIGHTS.frame(spark, sf_dir))


def b14_weighted_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weighted_correlations(_returns(spark, sf_dir), WEIGHTS.frame(spark, sf_dir))
    return found.select("symbol", F.round("most", 6).alias("most"), F.round("mean", 6).alias("mean"))


def a12_correlation_stress(spark: SparkSession, sf_dir: str, days: int = 400, least: int = 20) -> DataFrame:
    """Mean correlation of the universe over the newest days of each symbol, itself included with 1, and its class."""
    rows = _written(newest(_returns(spark, sf_dir), days))
    counted = _multiplied(rows, least, None, BLOCK, WHOLE).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.sum("total").alias("total"))
    counted = counted.join(rows.agg(F.count_distinct("symbol").alias("symbols")))
    mean = (2 * F.coalesce("total", F.lit(0.0)) + F.col("symbols")) / (2 * F.col("pairs") + F.col("symbols"))
    return counted.where("symbols >= 2").select("symbols", "pairs", F.round(mean, 6).alias("mean"), F.when(mean > 0.7, "STRESS").when(mean < 0.1, "LOW").otherwise("NORMAL").alias("status"))


MOST_CLUSTER, PENALTY = 0.25, 20.0


def b17_diversification_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0 to 100: the mean of effective number over number of positions and of 1 - HHI of the sectors, less PENALTY where a
    cluster of correlated symbols weighs more than MOST_CLUSTER."""
    stakes = POSITIONS.frame(spark, sf_dir).groupBy("symbol", "sector").agg(F.sum("weight").alias("w"))
    symbols = stakes.agg(F.count("*").alias("n"), (1 / F.sum(F.pow("w", F.lit(2)))).alias("effective"))
    sectors = stakes.groupBy("sector").agg(F.sum("w").alias("w")).agg((100 * (1 - F.sum(F.pow("w", F.lit(2))))).alias("sector_score"))
    largest = b15_correlation_clusters(spark, sf_dir).agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("largest"))
    joined = symbols.join(sectors).join(largest)  # one row each
    concentration = F.least(F.lit(100.0), 100 * F.col("effective") / F.col("n"))
    penalty = F.when(F.col("largest") > MOST_CLUSTER, PENALTY).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (concentration + F.col("sector_score")) / 2 - penalty))
    return joined.select(F.round(concentration, 6).alias("concentration"), F.round("sector_score", 6).alias("sector_score"), F.round("largest", 6).alias("largest_cluster"), penalty.alias("penalty"), F.round(score, 6).alias("score"))


QUERIES = {f.__name__: f for f in (b14_correlation_pairs, j11_pair_returns, b15_correlation_clusters, b14_weighted_correlation, a12_correlation_stress, b17_diversification_score)}


def _pairs_sql(rows: str, least: int) -> str:
    """Self-join by day, without blocks."""
    return f"SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, corr(a.r, b.r) AS c FROM {rows} a JOIN {rows} b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol HAVING count(*) >= {least} AND var_pop(a.r) > 0 AND var_pop(b.r) > 0"


_R = f"r0 AS MATERIALIZED (SELECT symbol, ts, r FROM ({RETURNS.sql}) x WHERE r IS NOT NULL)"
_RECENT = f"{_R}, r1 AS MATERIALIZED (SELECT symbol, ts, r FROM r0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 400)"
_CLUSTERS = f"e AS MATERIALIZED (SELECT a, b FROM p WHERE abs(c) >= {THRESHOLD}), l AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a, b FROM l UNION SELECT x.a, l.b FROM reach x JOIN l ON x.b = l.a), grouped AS (SELECT a AS symbol, min(b) AS cluster FROM reach GROUP BY a), w AS ({WEIGHTS.sql()}), clusters AS (SELECT cluster, g.symbol, count(*) OVER (PARTITION BY cluster) AS symbols, round(sum(coalesce(weight, 0)) OVER (PARTITION BY cluster), 9) AS weight FROM grouped g LEFT JOIN w ON w.symbol = g.symbol)"
_P = f"p AS MATERIALIZED ({_pairs_sql('r0', 30)})"
ORACLES = {
    "b14_correlation_pairs": f"WITH {_R} SELECT a, b, n, round(c, 6) AS correlation FROM ({_pairs_sql('r0', 30)}) p",
    "j11_pair_returns": f"WITH {_RECENT} SELECT a, b, n, round(c, 6) AS c FROM ({_pairs_sql('r1', 20)}) p",
    "b15_correlation_clusters": f"WITH RECURSIVE {_R}, {_P}, {_CLUSTERS} SELECT * FROM clusters",
    "b14_weighted_correlation": f"WITH {_R}, {_P}, w AS ({WEIGHTS.sql()}), both_ways AS (SELECT a AS symbol, b AS other, c FROM p UNION ALL SELECT b, a, c FROM p), t AS (SELECT x.symbol, x.c, o.weight AS wo, s.weight AS ws FROM both_ways x JOIN w o ON o.symbol = x.other JOIN w s ON s.symbol = x.symbol) SELECT symbol, round(max(c), 6) AS most, round(sum(wo * c) / sum(wo), 6) AS mean FROM t GROUP BY symbol UNION ALL SELECT -1, round(max(c), 6), round(sum(wo * ws * c) / sum(wo * ws), 6) FROM t",
    "a12_correlation_stress": f"WITH {_RECENT}, p AS ({_pairs_sql('r1', 20)}), m AS (SELECT (SELECT count(DISTINCT symbol) FROM r1) AS symbols, count(*) AS pairs, (2 * sum(c) + (SELECT count(DISTINCT symbol) FROM r1)) / (2 * count(*) + (SELECT count(DISTINCT symbol) FROM r1)) AS mean FROM p) SELECT symbols, pairs, round(mean, 6) AS mean, CASE WHEN mean > 0.7 THEN 'STRESS' WHEN mean < 0.1 THEN 'LOW' ELSE 'NORMAL' END AS status FROM m",
    "b17_diversification_score": f"WITH RECURSIVE {_R}, {_P}, {_CLUSTERS}, k AS (SELECT symbol, sector, sum(weight) AS weight FROM ({POSITIONS.sql}) x GROUP BY symbol, sector), q AS (SELECT least(100.0, 100 / sum(weight * weight) / count(*)) AS concentration, 100 * (1 - (SELECT sum(y.s * y.s) FROM (SELECT sum(weight) AS s FROM k GROUP BY sector) y)) AS sector_score, (SELECT coalesce(max(weight), 0.0) FROM clusters) AS largest FROM k) SELECT round(concentration, 6) AS concentration, round(sector_score, 6) AS sector_score, round(largest, 6) AS largest_cluster, CASE WHEN largest > {MOST_CLUSTER} THEN {PENALTY} ELSE 0.0 END AS penalty, round(greatest(0.0, least(100.0, (concentration + sector_score) / 2 - CASE WHEN largest > {MOST_CLUSTER} THEN {PENALTY} ELSE 0.0 END)), 6) AS score FROM q",
}
