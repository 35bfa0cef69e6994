"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised benchmark items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.automaton import automaton
from barloom.llm.common import cut, small_batches

WINDOW = 10
BLOCK_BYTES = 8_000_000  #: text of the windows and ids in one automaton; a larger benchmark takes a pass for each block
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return (text or b"").translate(_FOLD).split()


def _windows(batches):
    """Distinct windows of each item with the item's id."""
    for batch in batches:
        found = {(" ".join(w[i : i + WINDOW]), item) for item, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if item is not None and (w := [x.decode("latin-1") for x in words_of(t)]) for i in range(max(1, len(w) - WINDOW + 1))}
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["window", "item_id"])


def _original(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the text of spans of words."""
    places = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, chars, seen = [], 0, 0
    for a, b in spans:
        start, end = places[a][0], places[b - 1][1]
        chars += len(text[seen:start].decode("utf-8", "replace"))
        size = len(text[start:end].decode("utf-8", "replace"))
        out.append((chars, chars + size))
        chars, seen = chars + size, end
    return out


def _scan(patterns: Broadcast):
    """One more automaton over the texts: its hits join the runs and items that earlier ones found."""

    def run(batches):
        machine = automaton(patterns.value) if patterns.value else None
        for batch in batches:
            all_runs, all_items = [], []
            for text, before, own in zip(*(batch.column(c).to_pylist() for c in ("text", "_runs", "_items")), strict=True):
                words, hit, own = words_of(text), [], set(own)
                if machine and words:
                    line = f" {b' '.join(words).decode('latin-1')} "
                    for end, (n, ids) in machine.iter(line):
                        hit.append((end, n))
                        own.update(ids)
                if hit:
                    starts = np.cumsum([1] + [len(w) + 1 for w in words])  # of the words in the line; the last one is past the end
                    ends = np.searchsorted(starts, [e for e, _ in hit]).tolist()
                    before = _joined([(x["first"], x["last"]) for x in before] + [(e - n, e) for e, (_, n) in zip(ends, hit, strict=True)])
                all_runs.append(before)
                all_items.append(sorted(own))
            others = [c for c in batch.schema.names if c not in ("_runs", "_items")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(all_runs, _pairs("first", "last")), pa.array(all_items, pa.list_(pa.string()))], [*others, "_runs", "_items"])

    return run


def _joined(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [{"first": a, "last": b} for a, b in runs]


def _pairs(a: str, b: str) -> pa.DataType:
    return pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))


def _measure(batches):
    for batch in batches:
        n_words, spans = [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("_runs").to_pylist(), strict=True):
            n_words.append(len(words_of(text)))
            spans.append([{"start": a, "end": b} for a, b in _original(text, [(x["first"], x["last"]) for x in runs])] if runs else [])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(spans, _pairs("start", "end"))], [*batch.schema.names, "n_words", "spans"])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, tuple[int, list[str]]]]]:
    """The automata's patterns: ' w1 ... wn ' -> (n, items), in blocks of bounded size, each collected when it is due.
    The parts are dealt by (window, item), so that neither a window of all items nor an item of all windows is in one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    found = cut(items.mapInArrow(_windows, "window string, item_id string").distinct(), "windows")
    size = found.agg(F.sum(F.length("window") + F.length("item_id") + 2).alias("n")).first()["n"] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("window", "item_id"), F.lit(n))
    for k in range(n):
        patterns: dict[str, list[str]] = {}
        for r in found.where(part == k).collect():  # BLOCK_BYTES of text, about
            patterns.setdefault(r["window"], []).append(r["item_id"])
        yield sorted((f" {w} ", (w.count(" ") + 1, sorted(ids))) for w, ids in patterns.items())


_NAMES = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Adds to docs(text, ...) by benchmark(item_id, text, ...): n_words, n_hit, n_items, items, items_sha256,
    contaminated and spans (start and end in characters of the original text). Columns of docs with these names are
    replaced, all others stay.

    An item's windows are its runs of WINDOW words, or the whole item if it has fewer. All windows stand in one
    automaton, which scans each text once. A benchmark with more than BLOCK_BYTES of windows takes one pass over the
    texts for each block of that size, with one block in memory at a time and the hits so far written in between; the
    result is the same. A null text has no words; a very long one is scanned whole inside its row; null items and items
    without words match nothing; items with equal windows all count; items of one id are one item. items_sha256 of no
    item is that of the empty string. Repeated rows give repeated results; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.drop(*_NAMES)
    inner = {c: f"_{k}{'_' * max(map(len, rows.columns))}" for k, c in enumerate(("_runs", "_items")) if c in rows.columns}  # the caller's, set aside
    rows = rows.withColumnsRenamed(inner)
    pair = "array<struct<{}: bigint, {}: bigint>>"
    found = rows.withColumns({"text": F.col("text").cast("binary"), "_runs": F.array().cast(pair.format("first", "last")), "_items": F.array().cast("array<string>")})
    others = [f for f in found.schema.fields if f.name not in ("_runs", "_items")]
    scanned = T.StructType([*others, *found.select("_runs", "_items").schema.fields])
    for k, patterns in enumerate(_blocks(benchmark)):
        found = (cut(found, "scanned") if k else found).mapInArrow(_scan(spark.sparkContext.broadcast(patterns)), scanned)
    found = found.mapInArrow(_measure, T.StructType([*scanned.fields, *T.StructType.fromDDL(f"n_words bigint, spans {pair.format('start', 'end')}").fields]))
    n_hit = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return found.withColumns({
        "text": F.col("text").cast("string"), "n_hit": n_hit, "n_items": F.size("_items").cast("long"), "items": F.col("_items"),
        "items_sha256": F.sha2(F.array_join("_items", ",").cast("binary"), 256), "contaminated": n_hit > 0,
    }).drop("_runs", "_items").withColumnsRenamed({own: c for c, own in inner.items()})
