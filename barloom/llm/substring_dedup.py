"""Repeated passages: a count-min sketch finds the windows that may repeat, an exact pass judges only those.

Each piece of the input counts its windows in ROWS rows of cells that saturate at two. Pieces are merged cell by cell, in
groups of bounded size, and what remains is one bit for each cell: met twice or not. A cell counts every window that falls
into it, so it never says once of a window that was met twice, and no repeat is lost; windows that only seem to repeat
cost a row of the second pass. The sketch grows with the input up to MOST_CELLS bits, which is what a task gets at most;
beyond that it passes more windows on, and the result is the same.

The second pass first settles what it can inside a task: of the rows that share a window there, only those of the smallest
id are sent to meet the other tasks, so a window that a third of all documents share is one row for each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import cut, small_batches, text_runs

WINDOW = 13  #: words
ROWS, CELLS_PER_WORD = 2, 6
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 30
SEGMENT = 1 << 22  #: cells of a row that are merged together
PIECE = 4_000_000  #: windows that a task counts before it hands its cells on
PIECE_BYTES = 1 << 24  #: text of a piece, about
TOGETHER = 64  #: pieces that one group merges
MOST_MARKS = 1 << 27  #: bits that name the documents that lose words, at most
HELD = 700_000  #: windows that seem to repeat which a task settles together
BLOCK = 1 << 15  #: windows that are hashed together, so that they stay in the processor's cache
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_ODD = (np.random.default_rng(13).integers(0, 1 << 63, (64, 2), np.uint64) << np.uint64(1)) | np.uint64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in two columns of 64 bits, and the number of words of each text. Words are read
    eight bytes at a time, all words together."""
    encoded = [t.encode() for t in texts]
    data = b" " + b" ".join(encoded) + b" " * 9
    buffer = np.frombuffer(data, np.uint8)
    space = _SPACE[buffer]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    firsts = np.searchsorted(starts, 1 + np.concatenate([[0], np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1)]))
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    columns = []
    for k in range(2):
        h, at, rest = sizes.astype(np.uint64) * _ODD[62, k], 0, slice(None)
        while at == 0 or len(rest):
            eight = eights[starts[rest] + at] & _FIRST_BYTES[np.minimum(sizes[rest] - at, 8)]
            x = (h[rest] ^ eight) * _ODD[63, k]
            h[rest] = x ^ (x >> np.uint64(29))
            at += 8
            rest = np.flatnonzero(sizes > at) if at == 8 else rest[sizes[rest] > at]
        columns.append(h)
    return np.stack(columns), np.diff(firsts)


def window_keys(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two columns of 64-bit keys of all windows, the text that each stands in and the word of the text that it starts at."""
    h, sizes = word_hashes(texts)
    n = max(0, h.shape[1] - window + 1)
    out = np.zeros((2, n), np.uint64)
    for k in range(2):
        for start in range(0, n, BLOCK):
            part = out[k, start : start + BLOCK]
            for i in range(window):
                part += h[k, start + i : start + i + len(part)] * _ODD[i % 62, k] * np.uint64(2 * (i // 62) + 1)
            part ^= part >> np.uint64(32)
            part *= np.uint64(0x9E3779B97F4A7C15)
            part ^= part >> np.uint64(29)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.arange(n) + window <= ends[text]
    return out[:, inside], text[inside], (np.arange(n) - (ends - sizes)[text])[inside]


def _cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (((keys[row] >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)).astype(np.uint32)


def packed(cells: np.ndarray) -> bytes:
    """Ascending places in a segment: one bit for each place of a full segment (after a byte 1), else the steps from one to
    the next, a byte each, with 255 for a step that goes on (after a byte 0)."""
    if 8 * len(cells) > SEGMENT:
        bits = np.zeros(SEGMENT, bool)
        bits[cells] = True
        return b"\1" + np.packbits(bits).tobytes()
    more, last = np.divmod(np.diff(cells, prepend=0), 255)
    out = np.full(int(more.sum()) + len(cells), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = last
    return b"\0" + out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8, offset=1)
    return np.flatnonzero(np.unpackbits(steps)) if data[0] else np.cumsum(steps, dtype=np.int64)[steps < 255]


def _segments(held: list[np.ndarray], width: int, piece: int):
    """(segment, piece, once, twice) of one piece: the cells met once or more, and twice or more, a row at a time."""
    per_row = -(-width // SEGMENT)
    for row in range(ROWS):
        cells = np.concatenate([h[row] for h in held])
        cells.sort()
        again = np.concatenate([[False], cells[1:] == cells[:-1]])
        once, twice = cells[~again], np.unique(cells[again])
        edges = np.arange(per_row + 1) * SEGMENT
        a, b = np.searchsorted(once, edges), np.searchsorted(twice, edges)
        for s in range(per_row):
            if a[s] < a[s + 1]:
                yield {"segment": row * per_row + s, "piece": piece, "once": packed(once[a[s] : a[s + 1]] - edges[s]), "twice": packed(twice[b[s] : b[s + 1]] - edges[s])}


_SKETCH = pa.schema([("segment", pa.int64()), ("piece", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])


def _sketch(width: int, window: int):
    def run(batches):
        held, n, made = [], 0, 0
        for batch in batches:
            for _, texts in text_runs(batch.column("text").to_pylist()):
                keys = window_keys(texts, window)[0]
                held.append(np.stack([_cells(keys, row, width) for row in range(ROWS)]))
                n += keys.shape[1]
                if n >= PIECE:
                    for row in _segments(held, width, (TaskContext.get().partitionId() << 20) + made):
                        yield pa.RecordBatch.from_pylist([row], _SKETCH)
                    held, n, made = [], 0, made + 1
        if n:
            for row in _segments(held, width, (TaskContext.get().partitionId() << 20) + made):
                yield pa.RecordBatch.from_pylist([row], _SKETCH)

    return run


def _merged(table: pa.Table) -> pa.Table:
    once, twice = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
    for a, b in zip(table.column("once"), table.column("twice"), strict=True):
        cells = unpacked(a.as_py())
        twice[unpacked(b.as_py())] = True
        twice[cells[once[cells]]] = True
        once[cells] = True
    values = [packed(np.flatnonzero(x)) for x in (once, twice)]
    return pa.table({"segment": [table.column("segment")[0].as_py()], "piece": [table.column("together")[0].as_py()], "once": values[:1], "twice": values[1:]}, _SKETCH)


def repeat_sketch(docs: DataFrame, width: int, window: int, size: int) -> list[np.ndarray]:
    """For each row of the sketch a bit for each of `width` cells: whether windows fell into it twice or more. size, the
    bytes of all texts, says in how many rounds pieces are merged."""
    schema = "segment long, piece long, once binary, twice binary"
    parts, groups = docs.select("text").mapInArrow(_sketch(width, window), schema), -(-size // (PIECE_BYTES * TOGETHER))
    while True:
        together = F.pmod(F.xxhash64("piece"), F.lit(groups)) if groups > 1 else F.lit(0)
        parts = parts.withColumn("together", together.cast("long")).groupBy("segment", "together").applyInArrow(_merged, schema)
        if groups <= 1:
            break
        groups = -(-groups // TOGETHER)
    per_row = -(-width // SEGMENT)
    out = [np.zeros(per_row * SEGMENT // 8, np.uint8) for _ in range(ROWS)]
    for segment, twice in cut(parts.select("segment", "twice"), "sketch").toLocalIterator():  # a file at a time
        row, s = divmod(segment, per_row)
        bits = np.zeros(SEGMENT, bool)
        bits[unpacked(bytes(twice))] = True
        out[row][s * SEGMENT // 8 : (s + 1) * SEGMENT // 8] = np.packbits(bits)
    return out


def _settled(held: list[tuple], ids: pa.Array, marks: pa.Array):
    """Rows of windows (hi, lo, doc_id, mark, at, n) from (keys, row, at) of one piece. Where a row of a smaller id in the
    piece holds the window, the window goes: n consecutive ones are one row, with a key of its own. Others have n = 0."""
    hi, lo = (np.concatenate([k[c] for k, _, _ in held]) for c in range(2))
    row, at = (np.concatenate([h[c] for h in held]) for c in (1, 2))
    rank = pc.rank(ids, tiebreaker="min").to_numpy()[row]
    order = np.lexsort((rank, lo, hi))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hi[order[1:]] != hi[order[:-1]]) | (lo[order[1:]] != lo[order[:-1]])
    least = rank[order[fresh]][np.cumsum(fresh) - 1]
    gone = np.zeros(len(order), bool)
    gone[order] = rank[order] > least
    open_ = np.flatnonzero(~gone)
    gone = np.flatnonzero(gone)
    gone = gone[np.lexsort((at[gone], row[gone]))]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(row[gone]) != 0) | (np.diff(at[gone]) != 1)])) if len(gone) else gone
    n = np.concatenate([np.zeros(len(open_), np.int64), np.diff(np.append(starts, len(gone)))])
    some = np.concatenate([open_, gone[starts]])
    hi = np.where(n > 0, np.uint64(0x9E3779B97F4A7C15) * (row[some] * 1_000_003 + at[some]).astype(np.uint64), hi[some])
    return [pa.array(hi.view(np.int64)), pa.array(lo[some].astype(np.uint32).view(np.int32)), ids.take(pa.array(row[some])), marks.take(pa.array(row[some])), pa.array(at[some].astype(np.int32)), pa.array(n.astype(np.int32))]


def _seem_repeated(sketch, width: int, window: int):
    def run(batches):
        rows = [np.frombuffer(row, np.uint8) for row in sketch.value]
        held, n, base, ids, marks = [], 0, 0, [], []

        def flush():
            table = pa.RecordBatch.from_arrays(_settled(held, pa.concat_arrays(ids), pa.concat_arrays(marks)), ["hi", "lo", "doc_id", "mark", "at", "n"])
            for start in range(0, len(table), 50_000):
                yield table.slice(start, 50_000)

        for batch in batches:
            ids.append(batch.column("doc_id"))
            marks.append(batch.column("mark"))
            for first, texts in text_runs(batch.column("text").to_pylist()):
                keys, text, at = window_keys(texts, window)
                seem = np.arange(keys.shape[1])
                for row in range(ROWS):
                    cells = _cells(keys[:, seem], row, width)
                    seem = seem[(rows[row][cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1]
                held.append((keys[:, seem], base + first + text[seem], at[seem]))
                n += len(seem)
            base += batch.num_rows
            if n >= HELD:
                yield from flush()
                held, n, base, ids, marks = [], 0, 0, [], []
        if n:
            yield from flush()

    return run


def _touched(gone: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each hash of an id that loses words, MOST_MARKS bits at most, and the number of bits."""
    slots = min(MOST_MARKS, -(-max(1, 16 * gone.count()) // 32_768) * 32_768)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    parts = gone.groupBy(F.floor(slot / 32_768).alias("part")).agg(F.bitmap_construct_agg(slot % 32_768).alias("bits")).collect()
    out = np.zeros(slots // 8, np.uint8)
    for part, bits in parts:
        out[part * 4096 : (part + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out, slots


def _is_touched(batch: pa.RecordBatch, bits: np.ndarray) -> np.ndarray:
    slot = batch.column("slot").to_numpy()
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _waiting(touched):
    """Rows of the ids whose bit is set."""

    def run(batches):
        bits = np.frombuffer(touched.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(_is_touched(batch, bits))).select(["doc_id", "mark", "text"])

    return run


def _clean(words: list[bytes], gone: list[int], window: int) -> tuple[list[bytes], list[dict]]:
    """The words outside of all windows, and the runs that the windows cover; an entry is the first window of a run of n (0
    is a run of one) at 2^32 * at + n."""
    spans, kept, last = [], [], 0
    for start, end in sorted(((g >> 32), (g >> 32) + max(g & 0xFFFFFFFF, 1) - 1 + window) for g in gone):
        if spans and start <= spans[-1]["end"]:
            spans[-1]["end"] = max(end, spans[-1]["end"])
        else:
            spans.append({"start": start, "end": end})
    for s in spans:
        kept += words[last : s["start"]]
        last = s["end"]
    return kept + words[last:], spans


def _cleaned(window: int, touched=None):
    """Results of all rows, or of those whose bit is not set: they have nothing to lose."""

    def run(batches):
        pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        bits = None if touched is None else np.frombuffer(touched.value, np.uint8)
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(~_is_touched(batch, bits)))
            found = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist() if bits is None else [None] * batch.num_rows, strict=True):
                words = (text or "").encode().split()
                kept, spans = _clean(words, gone or [], window)
                found.append((len(words), len(words) - len(kept), b" ".join(kept).decode(), spans))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pairs), strict=True))], ["doc_id", "n_words", "n_removed", "clean_text", "spans"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_removed, clean_text, spans). A word goes if a window of `window` words
    covers it whose words also stand in a document with a smaller id; spans are the runs that went (words from 0, end
    excluded), clean_text the other words joined by one space. Windows are judged on the texts as they were.

    Null, empty and wordless texts have no words and give an empty text; texts of fewer words than a window lose none;
    very long texts are read whole. Rows without an id lose nothing and take nothing from others. Rows of one id are one
    document: they take nothing from each other, and equal rows lose the same words. An empty table gives an empty one.
    Other columns, whatever their names, are not read and not returned."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    repeated = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    docs = docs.withColumn("mark", F.hash("text") if repeated else F.lit(0))  # tells rows of one id apart
    named = docs.where("doc_id is not null")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MOST_CELLS, max(LEAST_CELLS, CELLS_PER_WORD * size // 6)) // ROWS
    sketch = spark.sparkContext.broadcast([row.tobytes() for row in repeat_sketch(named, width, window, size)])
    seem = named.mapInArrow(_seem_repeated(sketch, width, window), f"hi long, lo int, doc_id {id_type}, mark int, at int, n int")
    first = F.min(F.when(F.col("n") == 0, F.col("doc_id"))).over(Window.partitionBy("hi", "lo"))
    later = seem.withColumn("first", first).where("n > 0 or doc_id > first")
    gone = cut(later.groupBy("doc_id", "mark").agg(F.collect_list(F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")).alias("gone")), "gone")
    # Texts that lose nothing are not shuffled.
    bits, slots = _touched(gone)
    touched = spark.sparkContext.broadcast(bits.tobytes())
    marked = docs.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)))
    result = f"doc_id {id_type}, n_words long, n_removed long, clean_text string, spans array<struct<start: int, end: int>>"
    waiting = marked.mapInArrow(_waiting(touched), f"doc_id {id_type}, mark int, text string")
    judged = waiting.join(gone.hint("shuffle_hash"), ["doc_id", "mark"], "left").select("doc_id", "text", "gone")
    return marked.mapInArrow(_cleaned(window, touched), result).unionByName(judged.mapInArrow(_cleaned(window), result))
