"""Sum-of-squares packing of documents into sequences of fixed capacity."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut, small_batches
from barloom.llm.tokens import TABLE_BYTES, piece_ids

CAPACITY = 1024
GROUP_PIECES = 16_384  #: pieces that one task packs together, about
LOOSE_PERCENT = 3  #: a sequence with more room than this is opened again for the second pass


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each length of 1..capacity, placed in the given order.

    open[g] counts the open bins with room g. Placing a piece of length s in a bin with room g changes the sum of
    squares by 2 * (open[g - s] - open[g]) + 2, without the first part for a full bin and without the second for a new
    one; the smallest change wins, on ties the smallest room left.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        room = open_[s:capacity]
        change = np.where(room > 0, 2 * (open_[: capacity - s] - room) + 2, never)
        if len(change) and room[0] > 0:
            change[0] = 1 - 2 * int(room[0])  # closes the bin
        best = int(change.argmin()) if len(change) else 0
        fresh = 0 if s == capacity else 2 * int(open_[capacity - s]) + 1
        if len(change) and change[best] != never and change[best] <= fresh:
            gap = best + s
            at = stacks[gap].pop()
            open_[gap] -= 1
        else:
            gap, at, made = capacity, made, made + 1
        bins[i], offsets[i] = at, capacity - gap
        if gap > s:
            stacks[gap - s].append(at)
            open_[gap - s] += 1
    return bins, offsets


def _order(lengths: np.ndarray) -> np.ndarray:
    """Long pieces first: the small ones then find the room that is left."""
    return np.argsort(-lengths, kind="stable")


def _pack(groups: int, first: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start", "ids_crc32", "row"], kind="stable", na_position="first").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        order = _order(lengths)
        bins, offsets = sum_of_squares(lengths[order])
        at, place = np.empty_like(bins), np.empty_like(offsets)
        at[order], place[order] = bins, offsets
        room = CAPACITY - np.bincount(at, lengths, minlength=int(at.max()) + 1).astype(np.int64)
        number = first + (at * groups + pdf["part"].to_numpy(np.int64)) * 2
        return pdf.assign(sequence_id=number, offset=place, loose=100 * room[at] > LOOSE_PERCENT * CAPACITY)

    return run


def _pieces(path: str, end_id: int, most: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        table = piece_ids(path, keep_spaces=True, most=most)
        for batch in batches:
            ids, texts, rows = (batch.column(c) for c in ("doc_id", "text", "row"))
            which, piece, start, length, crc = [], [], [], [], []
            for i, ids_ in enumerate(table.encode(texts.to_pylist())):
                data = ids_ + end
                n = len(data) // 4
                cuts = [0, *range(n % CAPACITY or CAPACITY, n + 1, CAPACITY)]
                for k in range(len(cuts) - 1):
                    which.append(i)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(cuts[k + 1] - cuts[k])
                    crc.append(zlib.crc32(data[4 * cuts[k] : 4 * cuts[k + 1]]))
            where = pa.array(which, pa.int64())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(where), rows.take(where), *(pa.array(x, t) for x, t in zip((piece, start, length, crc), kinds, strict=True))],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row for each piece.

    A document is the ids of its text (null: none) and end_id. Only documents above CAPACITY are cut, into pieces of
    CAPACITY ids of which the first may be shorter. Pieces are dealt to groups of about GROUP_PIECES by a hash, each
    group is packed by sum_of_squares, and the sequences with more than LOOSE_PERCENT of room are packed once more in
    new groups. The counts of groups follow the number of pieces alone. table_bytes: memory of the words that a worker
    need not encode again; the result does not depend on it.

    Repeated rows are packed each for itself; ties are ordered by doc_id, piece and content; an empty table gives an
    empty result; a null doc_id is packed like any other; extra columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    kinds = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(rows.mapInArrow(_pieces(tokenizer_path, end_id, table_bytes), kinds), "pieces")
    packed = cut(_packed(pieces, 0), "packed")
    again = packed.where("loose").drop("sequence_id", "offset", "loose", "part")
    done = packed.where("not loose").unionByName(_packed(again, 1))
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _packed(pieces: DataFrame, first: int) -> DataFrame:
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    part = F.pmod(F.xxhash64(F.lit(first), "doc_id", "piece", "row"), F.lit(groups)).alias("part")
    kinds = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, part long, sequence_id long, offset long, loose boolean"
    return pieces.select("*", part).groupBy("part").applyInPandas(_pack(groups, first), kinds)
