"""Shards cut from a Hilbert curve over quantised metadata, so that files cover small boxes of all dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, shared_dir

SHARDS = 16
BITS = 5  #: of each dimension's coordinate
ACCURACY = 10_000  #: of the quantiles that cut a number
RANGES = 128  #: of a string dimension's distinct values
WHOLE_PERCENT = 30  #: equal texts of up to this part of a shard's bytes stay together, unless the caller says otherwise
_GROUP = ("h", "crc", "size")


def hilbert_index(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates of `bits` bits, one row each: Gray code with the reflections
    and exchanges undone from the highest bit down."""
    x = coordinates.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    index = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> b & 1)
    return index


def _edges(rows: DataFrame, column: str) -> list[str]:
    """Values of a string column at which its coordinate rises, by the order of whole strings: each of up to 2^BITS
    distinct values has its own coordinate; more are cut at quantiles of the rows. Distinct values are counted first and
    then sorted into ranges, of which one row each comes to the driver, so a frequent value is one counted row."""
    counts = cut(rows.groupBy(column).count(), "values")
    ranges = counts.repartitionByRange(RANGES, column).groupBy(F.spark_partition_id().alias("range")).agg(F.min(column).alias("first"), F.sum("count").alias("n"))
    found = sorted((r["first"], r["n"]) for r in ranges.collect())
    out, seen, total = [], 0, sum(n for _, n in found)
    for k, (first, n) in enumerate(found):
        coordinate = (k << BITS) // len(found) if len(found) <= 1 << BITS else (seen << BITS) // total
        out += [first] * (coordinate - len(out))  # few values are spread over all coordinates
        seen += n
    return out


def _curve(edges: list[list]):
    def run(batches):
        for batch in batches:
            points = np.stack([np.searchsorted(np.array(e, object if i < 2 else np.int64), batch.column(f"d{i}").to_numpy(zero_copy_only=False), side="right") for i, e in enumerate(edges)], axis=1)
            names = [c for c in batch.schema.names if not c.startswith("d") or c == "doc_id"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(hilbert_index(points))], [*names, "curve"])

    return run


def _summary(batches):
    """One row for a partition: its rows and bytes, its first and last group and where the last one starts."""
    pid, rows, bytes_, first, last, start = None, 0, 0, None, None, 0
    for batch in batches:
        if batch.num_rows:
            keys, size = _keys(batch), batch.column("size").to_numpy()
            pid, first = batch.column("pid")[0].as_py(), keys[0] if first is None else first
            fresh = np.flatnonzero([a != b for a, b in zip([last, *keys], keys, strict=False)])
            before = bytes_ + np.concatenate([[0], np.cumsum(size)])
            if len(fresh):
                start = int(before[fresh[-1]])
            last, rows, bytes_ = keys[-1], rows + batch.num_rows, int(before[-1])
    if pid is not None:
        text = lambda k: ",".join(map(str, k))
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "rows": [rows], "bytes": [bytes_], "first": [text(first)], "last": [text(last)], "start": [start]})


def _keys(batch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in ("curve", *_GROUP)), strict=True))


def _place(offsets: dict[int, tuple[int, int, int]], total: int, shards: int, whole_percent: float):
    def run(batches):
        last, start, seen, done = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            row0, byte0, carried = offsets[batch.column("pid")[0].as_py()]
            keys, size, copies = _keys(batch), batch.column("size").to_numpy(), batch.column("copies").to_numpy()
            before = byte0 + done + np.concatenate([[0], np.cumsum(size)])
            starts = np.empty(len(size), np.int64)
            for i, key in enumerate(keys):
                if key != last:
                    start = carried if last is None and carried >= 0 else int(before[i])
                    last = key
                starts[i] = start
            group = size * copies
            whole = 100 * shards * group <= whole_percent * total
            shard_of = lambda middle: np.minimum(shards - 1, middle * shards // (2 * total))  # noqa: E731  of twice a place
            shard = shard_of(np.where(whole, 2 * starts + group, 2 * before[:-1] + size))
            in_two = ~whole & (shard_of(2 * starts + size) < shard_of(2 * (starts + group) - size))
            rank = row0 + seen + np.arange(len(size))
            seen, done = seen + len(size), done + int(size.sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "crc")), pa.array(shard.astype(np.int32)), pa.array(rank), pa.array(in_two)], ["doc_id", "size", "text_crc32", "shard", "rank", "group_cut"])

    return run


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, whole_percent: float = WHOLE_PERCENT) -> DataFrame:
    """docs(doc_id, text, lang, source, n_chars, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard,
    group_cut.

    Law `bytes`: the rows stand in the order of the curve over (lang, source, n_chars), each dimension cut at its
    quantiles, then by text and doc_id; runs of near equal bytes make the shards, and slot counts the rows of a shard.
    Equal texts form a group, which takes the curve place of its smallest doc_id, so a group is one run. One law holds at
    every size: a run of up to `whole_percent` of a shard's bytes is never cut and goes where its middle lies, so a shard
    is off by half of that at either end at most; a longer one is cut where the bytes say (0: any may be cut, 100: none
    that fits a shard). group_cut names the rows of runs that lie in several shards. Sums come from one
    row for each partition, so no key or group has to fit a task.

    Null metadata count as the smallest value, a null text as empty; very long texts are read in place. Ties (equal text
    and doc_id) may stand in any order among themselves, as they are alike. An empty table gives an empty result; extra
    columns are not read.
    """
    spark = docs.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    numbers = {"d0": F.coalesce(F.col("lang").cast("string"), F.lit("")), "d1": F.coalesce(F.col("source").cast("string"), F.lit("")), "d2": F.coalesce(F.col("n_chars").cast("long"), F.lit(-1).cast("long"))}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h"), *(c.alias(n) for n, c in numbers.items()))
    rows = rows.checkpoint()
    steps = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    totals = rows.agg(F.sum("size").alias("total"), F.percentile_approx("d2", steps, ACCURACY).alias("d2")).first()
    edges = [_edges(rows, "d0"), _edges(rows, "d1"), totals["d2"] or []]
    groups = rows.groupBy(*_GROUP).agg(F.count("*").alias("copies"), F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), *numbers)).alias("m"))
    groups = groups.select(*_GROUP, "copies", *(F.col(f"m.{d}").alias(d) for d in numbers))
    placed = groups.mapInArrow(_curve(edges), "h long, crc long, size long, copies long, curve long")
    joined = rows.select("doc_id", *_GROUP).join(placed, list(_GROUP))
    order = ("curve", *_GROUP, "doc_id")
    sorted_ = joined.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()).checkpoint()

    offsets, row0, byte0, last, start = {}, 0, 0, None, 0
    for s in sorted(sorted_.mapInArrow(_summary, "pid int, rows long, bytes long, first string, last string, start long").collect()):  # one row for each partition
        offsets[s["pid"]] = (row0, byte0, start if s["first"] == last else -1)
        if not (s["first"] == s["last"] == last):
            start = byte0 + s["start"]
        last, row0, byte0 = s["last"], row0 + s["rows"], byte0 + s["bytes"]
    cut_ = sorted_.mapInArrow(_place(offsets, totals["total"] or 1, shards, whole_percent), "doc_id long, size long, text_crc32 long, shard int, rank long, group_cut boolean")
    firsts = cut_.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # as many rows as shards
    return cut_.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_cut")


def write_shards(docs: DataFrame, placed: DataFrame, folder: str) -> None:
    """Write whole rows of docs (unique doc_id) by shard and slot as Parquet under folder."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
