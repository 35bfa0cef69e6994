"""Quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_batches
from barloom.llm.labelled import labelled_sample

#: Labelled rows for fitting at most: of label 0 and of label 1.
SAMPLE = {0: 3_000, 1: 9_000}
WORD_BUCKETS = 1 << 13
BINS = 10  #: of each statistic, cut at quantiles of the sample
RANK = 8
EPOCHS, BATCH, RATE, PENALTY = 12, 128, 0.05, 1e-5
WORD_SHARE = 0.5  #: length of the word part of a row's vector
MAX_WORDS = 300_000
STATISTICS = [
    "bytes", "words", "word_bytes", "upper", "digits", "spaces", "beyond_ascii", "commas_stops", "exclamations", "bars", "signs",
    "distinct_words", "same_as_before", "commonest_word", "lines", "line_words", "equal_lines", "ended_lines", "n_chars", "n_chars_off",
]
FEATURES = WORD_BUCKETS + len(STATISTICS) * BINS
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class WordBuckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.strip(b".,;:!?\"'()")) % WORD_BUCKETS
        return value


_buckets = WordBuckets()


def describe(text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, their weights, statistics) of one whole text."""
    text = text or b""
    words = text.translate(_FOLD).split()
    size, n = max(1, len(text)), max(1, len(words))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    ids = np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))
    counts = np.bincount(ids, minlength=1)
    at = np.flatnonzero(counts)
    weights = np.log1p(counts[at]).astype(np.float32)
    weights *= WORD_SHARE / max(1e-9, float(np.sqrt((weights**2).sum())))
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text) - int(seen[0x80:0xC0].sum())
    statistics = [
        len(text), len(words), sum(map(len, words)) / n, seen[65:91].sum() / size, seen[48:58].sum() / size, seen[[9, 10, 13, 32]].sum() / size, seen[128:].sum() / size,
        seen[[44, 46]].sum() / n, seen[33] / n, seen[124] / n, seen[[35, 36, 37, 38, 42, 60, 61, 62, 94, 95, 126]].sum() / n,
        len(at) / min(n, WORD_BUCKETS), float((ids[1:] == ids[:-1]).mean()) if len(ids) > 1 else 0.0, counts.max() / n, len(lines), n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)), -1 if n_chars is None else n_chars, 0 if n_chars is None else abs(n_chars - chars),
    ]
    return at.astype(np.int32), weights, np.array(statistics, np.float32)


@dataclass
class Machine:
    edges: np.ndarray  #: (statistics, BINS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray  #: (features, RANK)

    def row(self, at: np.ndarray, weights: np.ndarray, statistics: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = (statistics[:, None] > self.edges).sum(axis=1)
        own = WORD_BUCKETS + np.arange(len(STATISTICS)) * BINS + bins
        return np.concatenate([at, own]), np.concatenate([weights, np.full(len(own), 1 / np.sqrt(len(own)), np.float32)])

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        """bias + linear + pairs, where the sum over all pairs is half of (sum of v x)^2 - sum of (v x)^2: linear time."""
        v = self.factors[at] * x[:, None]
        return float(self.bias + self.linear[at] @ x + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum()))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """AdaGrad on the logistic loss, in a fixed order drawn from a fixed seed. Without both labels the machine gives
    the one it saw (or 0.5)."""
    draw = np.random.default_rng(7)
    steps = np.arange(1, BINS) / BINS
    edges = np.quantile(np.stack([r[2] for r in rows]), steps, axis=0).T.astype(np.float32) if rows else np.zeros((len(STATISTICS), BINS - 1), np.float32)
    m = Machine(edges, 0.0, np.zeros(FEATURES, np.float32), draw.normal(0, 0.05, (FEATURES, RANK)).astype(np.float32))
    if len(set(labels.tolist())) < 2:
        m.bias, m.factors[:] = float({0: -3, 1: 3}[int(labels[0])] if len(labels) else 0), 0
        return m
    data = [m.row(*r) for r in rows]
    share = labels.mean()
    m.bias = float(np.log(share / (1 - share)))
    g_bias, g_linear, g_factors = 1e-6, np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, RANK), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = draw.permutation(len(data))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            at, x = np.concatenate([data[i][0] for i in some]), np.concatenate([data[i][1] for i in some])
            starts = np.concatenate([[0], np.cumsum([len(data[i][0]) for i in some])[:-1]])
            owner = np.repeat(np.arange(len(some)), [len(data[i][0]) for i in some])
            v = m.factors[at] * x[:, None]
            sums = np.add.reduceat(v, starts)
            margin = m.bias + np.add.reduceat(m.linear[at] * x, starts) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), starts))
            error = ((sigmoid(margin) - labels[some]) / len(some)).astype(np.float32)
            step = error[owner] * x
            used, place = np.unique(at, return_inverse=True)
            d_linear = np.bincount(place, step, len(used)).astype(np.float32) + PENALTY * m.linear[used]
            each = step[:, None] * (sums[owner] - v)
            d_factors = np.stack([np.bincount(place, each[:, r], len(used)) for r in range(RANK)], axis=1).astype(np.float32) + PENALTY * m.factors[used]
            g_bias += float(error.sum()) ** 2
            m.bias -= RATE * float(error.sum()) / np.sqrt(g_bias)
            g_linear[used] += d_linear**2
            m.linear[used] -= RATE * d_linear / np.sqrt(g_linear[used])
            g_factors[used] += d_factors**2
            m.factors[used] -= RATE * d_factors / np.sqrt(g_factors[used])
    return m


def _describe(batches):
    for batch in batches:
        rows = [describe(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), *(pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in range(3))], ["quality", "at", "weights", "statistics"])


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col("n_chars").cast("long").alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> Machine:
    """Train on a bounded sample of rows that are not held out (SAMPLE); executors describe the texts."""
    small_batches(docs.sparkSession)
    rows = labelled_sample(_columns(docs), labels, "quality", held_out, SAMPLE)
    found = rows.orderBy("doc_id", "text").select("text", "n_chars", F.col("quality").cast("int").alias("quality")).mapInArrow(_describe, "quality int, at binary, weights binary, statistics binary").toArrow()
    parts = [[np.frombuffer(x, t) for x in found.column(c).to_pylist()] for c, t in (("at", np.int32), ("weights", np.float32), ("statistics", np.float32))]
    return train(list(zip(*parts, strict=True)), found.column("quality").to_numpy().astype(np.int64))


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            scores = [float(sigmoid(m.margin(*m.row(*describe(t, n))))) for t, n in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs(doc_id, text, n_chars, ...) -> doc_id, score; one row for each input row.

    Inputs are the text and n_chars alone. A null or empty text is described by zeros, a null n_chars by a bin of its
    own. Repeated rows score alike; ties do not arise; an empty table gives an empty result; extra columns are not read.
    """
    small_batches(docs.sparkSession)
    return _columns(docs).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(machine)), "doc_id long, score double")
