"""Language by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_batches, text_runs

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15  #: for each order
SLICE = 1_000_000  #: n-grams worked on at once
MAX_CELLS = 1 << 25  #: of the broadcast matrix (128 MiB): languages times buckets of all orders
SMOOTHING = 0.5
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; built once for each worker."""
    if not _tables:
        _tables.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _tables[0]


def grams(texts: list[str], buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, buckets of n-grams, the text each belongs to), SLICE n-grams at a time, each n-gram of the whole texts
    once. Letters are lower-cased, everything else is a space, runs of spaces are one."""
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    keep[:1] = True
    codes, owner = np.where(letter, codes, np.uint32(32))[keep], owner[keep]
    for k, n in enumerate(ORDERS):
        for first in range(0, len(codes) - n + 1, SLICE):
            m = min(SLICE, len(codes) - n + 1 - first)
            h = np.full(m, n, np.uint32)
            for i in range(n):
                h ^= codes[first + i : first + i + m]
                h *= np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            inside = owner[first : first + m] == owner[first + n - 1 : first + n - 1 + m]
            yield k, ((h >> np.uint32(7)) & np.uint32(buckets - 1))[inside], owner[first : first + m][inside]


def _count(buckets: int):
    """Counts of a task by language, order and bucket; only a vector for each language is held."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in text_runs(batch.column("text").to_pylist()):
                own = langs[at : at + len(texts)]
                names = sorted(set(own))
                counts |= {n: np.zeros(len(ORDERS) * buckets, np.int64) for n in names if n not in counts}
                place = {n: j for j, n in enumerate(names)}
                code = np.array([place[x] for x in own])
                for k, bucket, owner in grams(texts, buckets):
                    found = np.bincount(code[owner].astype(np.int64) * buckets + bucket, minlength=len(names) * buckets).reshape(len(names), buckets)
                    for j, n in enumerate(names):
                        counts[n][k * buckets : (k + 1) * buckets] += found[j]
        for n, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    return run


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  #: (orders * buckets, languages) of log probabilities
    priors: np.ndarray
    buckets: int = BUCKETS


def fit(docs: DataFrame, buckets: int = BUCKETS) -> Languages:
    """Train on all rows of docs(text, lang) with both. The matrix has languages x orders x `buckets` (a power of two)
    cells; more than MAX_CELLS are refused: take fewer buckets for many languages."""
    small_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    most = MAX_CELLS // (len(ORDERS) * buckets)
    sizes = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().limit(most + 1).collect())
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages with {buckets} buckets for each order: pass fewer buckets")
    names = [n for n, _ in sizes]
    counts = np.zeros((len(ORDERS) * buckets, len(names)), np.float32)
    found = known.mapInArrow(_count(buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each cell
    place = {n: i for i, n in enumerate(names)}
    if names:
        counts[found.column("bucket").to_numpy(), np.array([place[x] for x in found.column("lang").to_pylist()], np.int64)] = found.column("n").to_numpy()
    logs = np.log(counts + np.float32(SMOOTHING))
    for k in range(len(ORDERS)):  # each order is a distribution of its own
        part = slice(k * buckets, (k + 1) * buckets)
        logs[part] -= np.log(counts[part].sum(axis=0, dtype=np.float64) + SMOOTHING * buckets).astype(np.float32)
    total = sum(c for _, c in sizes)
    return Languages(names, logs, np.log(np.array([c for _, c in sizes]) / total) if names else np.empty(0), buckets)


def _predict(model):
    def run(batches):
        languages = model.value
        n, logs = len(languages.names), languages.logs
        step = max(1, 2_000_000 // max(1, n))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sums = np.zeros((len(texts), n))
            for at, part in text_runs(texts):
                for k, bucket, owner in grams(part, languages.buckets):
                    for i in range(0, len(bucket), step):
                        own = owner[i : i + step]
                        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        sums[at + own[starts]] += np.add.reduceat(logs[k * languages.buckets + bucket[i : i + step].astype(np.int64)], starts, axis=0, dtype=np.float64)
            names, scores = [], []
            for i, t in enumerate(texts):
                if not n or not t or not _LETTER.search(t):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                joint = sums[i] / len(ORDERS) + languages.priors
                best = int(joint.argmax())
                names.append(languages.names[best])
                scores.append(float(1 / np.exp(joint - joint[best]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, model: Languages) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score, one row for each input row.

    The orders are three readings of one text, so the evidence is their mean; score is the posterior of the answer by
    that evidence and the priors. A null text, one without a letter, or a model without languages gives `und` and score
    0. A very long text is read whole, SLICE n-grams at a time. Ties take the language that sorts first. Repeated rows are scored alike, an empty table gives an empty result, extra columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """Fit on the rows that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out))
    return predict_language(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")
