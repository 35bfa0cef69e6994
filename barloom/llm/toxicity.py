"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.automaton import automaton
from barloom.llm.common import small_batches, text_runs
from barloom.llm.labelled import labelled_sample

#: Labelled rows for fitting at most: of label 0 and of label 1.
SAMPLE = {0: 16_000, 1: 4_000}
PREFIXES = range(4, 9)  #: lengths of word beginnings that can become entries
MIN_DOCS = 4  #: toxic rows that hold an entry at least
FLUSH = 50_000  #: terms that a task counts before it hands them on
PRECISION = 0.8  #: toxic share of an entry's texts, and of its contexts, at least
CHANCE = 0.01  #: chance that any entry at all is one by accident
SEED_WEIGHT = 3.0

# Fixed values.
SEEDS = ["bastard", "disgusting", "dumb", "filthy", "freak", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "retard", "scum", "scumbag", "stupid", "ugly", "vermin", "worthless"]
EXCEPTIONS = ["dumb bell", "dumb waiter", "idiot light", "idiot proof", "jerk chicken", "loser bracket", "sore loser rule", "trash bag", "trash bin", "trash can", "ugly duckling"]
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "һ": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ӏ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"

_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """(code point -> folded letter, or 0 for other characters; code point -> letter that it replaces, or 0)."""
    if not _tables:
        fold, swap = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                fold[c] = ord(HOMOGLYPHS.get(low, low)[0])
        for c in range(0xFF21, 0xFF5B):  # full width
            if fold[c]:
                fold[c] = ord(chr(c - 0xFEE0).lower())
        for a, b in SUBSTITUTES.items():
            swap[ord(a)] = ord(b)
        _tables.append((fold, swap))
    return _tables[0]


def fold(texts: list[str]) -> list[str]:
    """Lower-cased letters with homoglyphs folded; digits and signs that stand for letters are folded beside a letter;
    invisible characters vanish; everything else is one space for each run. Texts start and end with a space."""
    letters, swap = _fold_tables()
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([1, *(len(t) + 1 for t in texts)])
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)  # a text owns the line feed behind it
    seen = ~np.isin(codes, np.array([ord(c) for c in INVISIBLE], np.uint32))
    codes, owner = codes[seen], owner[seen]
    out = letters[codes]
    for _ in range(2):  # twice: a substitute beside a folded one
        beside = np.zeros(len(out), bool)
        beside[1:] |= out[:-1] > 0
        beside[:-1] |= out[1:] > 0
        out = np.where((out == 0) & beside, swap[codes], out)
    word = out > 0
    keep = word.copy()
    keep[1:] |= word[:-1] | (owner[1:] != owner[:-1])
    keep[:1] = True
    out, owner = np.where(word, out, np.uint32(32))[keep], owner[keep]
    line = out.astype("<u4").tobytes().decode("utf-32-le", "replace")
    ends = np.searchsorted(owner, np.arange(1, len(texts) + 2)).tolist()
    return [line[ends[i] : ends[i + 1]] if line[ends[i] : ends[i] + 1] == " " else f" {line[ends[i] : ends[i + 1]]}" for i in range(len(texts))]


@dataclass
class Lexicon:
    """Entries ' word ' or ' beginning' with weights, phrases that excuse what they cover, and the logistic scale."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=lambda: [f" {p} " for p in EXCEPTIONS])
    scale: tuple[float, float, float] = (-4.0, 2.5, 1.0)

    def patterns(self) -> list[tuple[str, object]]:
        known = {e: (len(e), w) for e, w in self.entries.items()} | {p: (len(p), None) for p in self.exceptions}
        return sorted(known.items())

    def hits(self, text: str, machine) -> tuple[float, int, list[str]]:
        """Sum of weights, number of hits and the entries of one folded text; the longest entry at a place counts."""
        best: dict[int, tuple[int, float]] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in machine.iter(text):
            start = end - size + 1
            if weight is None:
                excused.append((start, end))
            elif start not in best or size > best[start][0]:
                best[start] = (size, weight)
        for a, b in excused:
            for at in [at for at in best if a <= at < b]:
                del best[at]
        return sum(w for _, w in best.values()), len(best), sorted({text[a : a + n].strip() for a, (n, _) in best.items()})

    def score(self, total: float, words: int) -> float:
        a, b, c = self.scale
        x, y = features(total, words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def features(total: float, words: int) -> tuple[float, float]:
    """Amount, and amount by length."""
    return math.log1p(max(0.0, total)), math.log1p(100 * max(0.0, total) / (words + 20))


def _terms(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIXES if n < len(word))]


def _folded(batch):
    return (x for _, part in text_runs(batch.column("text").to_pylist()) for x in fold(part))


def _doc_counts(batches):
    """Rows (term, toxic, n): texts that hold a term, FLUSH terms at a time."""

    def given(counts: Counter) -> pa.RecordBatch:
        rows = sorted(counts.items())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["term", "toxic", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text, toxic in zip(_folded(batch), batch.column("toxic").to_pylist(), strict=True):
            counts.update((t, toxic) for t in {t for w in set(text.split()) for t in _terms(w)})
            if len(counts) > FLUSH:
                yield given(counts)
                counts.clear()
    yield given(counts)


def _evidence(terms: frozenset[str]):
    """Rows (term, toxic, context) for the candidate terms: contexts are the neighbour words, so copies give one."""

    def run(batches):
        for batch in batches:
            seen = set()
            for text, toxic in zip(_folded(batch), batch.column("toxic").to_pylist(), strict=True):
                words = ["", *text.split(), ""]
                for i in range(1, len(words) - 1):
                    for t in _terms(words[i]):
                        if t in terms:
                            seen.add((t, toxic, hash_of(words[i - 1], words[i], words[i + 1])))
            rows = sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["term", "toxic", "context"])

    return run


def hash_of(*words: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(words).encode("utf-8", "replace")) - (1 << 63)


def _chosen(found: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Entries whose contexts are toxic beyond chance (a bound on the binomial tail, over all candidates), best first;
    of an entry and its beginnings one is kept."""
    if not toxic or not clean:
        return {}
    p0, limit, scored = toxic / (toxic + clean), math.log(max(1, len(found)) / CHANCE), []
    for term, a, b in found:
        n, p = a + b, a / (a + b)
        gain = n * (p * math.log(p / p0) + ((1 - p) * math.log((1 - p) / (1 - p0)) if b else 0)) if p > p0 else 0
        if gain >= limit and p >= PRECISION:
            scored.append((-gain, len(term), term, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))))
    kept: dict[str, float] = {}
    covered: set[str] = set()
    for _, _, term, weight in sorted(scored):
        own = {term[:n] for n in range(5, len(term) + 1)}
        if term not in covered and not own & kept.keys():
            kept[term] = weight
            covered |= own
    return kept


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> Lexicon:
    """Learn the lexicon and the scale from a bounded sample of rows that are not held out (SAMPLE).

    Null texts and labels are not learned from, empty texts hold no term, very long ones are read whole, and equal texts
    count once. Without rows of both labels the lexicon has its seeds alone and the scale it starts with; so it has for an
    empty table. Other columns are not read."""
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, "toxic", held_out, SAMPLE)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    texts = rows.select("text", F.col("toxic").cast("int").alias("toxic"))
    toxic, every = F.sum(F.col("n") * F.col("toxic")), F.sum("n")
    likely = texts.mapInArrow(_doc_counts, "term string, toxic int, n long").groupBy("term").agg(toxic.alias("a"), every.alias("n")).where((F.col("a") >= MIN_DOCS) & (F.col("a") / F.col("n") >= PRECISION))
    candidates = frozenset(r["term"] for r in likely.select("term").collect())  # of the words of SAMPLE's toxic rows
    seen = texts.mapInArrow(_evidence(candidates), "term string, toxic int, context long")
    by_term = seen.groupBy("term").agg(F.count_distinct(F.when(F.col("toxic") == 1, F.col("context"))).alias("a"), F.count_distinct(F.when(F.col("toxic") == 0, F.col("context"))).alias("b")).where("a > 0")
    found = [(r["term"], r["a"], r["b"]) for r in by_term.collect()]
    entries = _chosen(sorted(found), sizes.get(1, 0), sizes.get(0, 0))
    against = {t.strip() for t, a, b in found if b > a}
    for seed in SEEDS:
        if seed not in against and not any(f" {seed[:n]}" in entries for n in PREFIXES):
            entries.setdefault(f" {seed} ", SEED_WEIGHT)
    lexicon = Lexicon(entries)
    if len(sizes) == 2:
        seen = score_toxicity(rows.select("text", "toxic"), lexicon).select("toxic", "total", "n_terms").collect()
        lexicon.scale = _logistic([features(r["total"], r["n_terms"]) for r in seen], [r["toxic"] for r in seen])
    return lexicon


def _logistic(x: list[tuple[float, float]], y: list[int], ridge: float = 1.0) -> tuple[float, float, float]:
    """Three coefficients by Newton steps, held near zero by a small penalty."""
    a, t, w = np.column_stack([np.ones(len(x)), np.array(x)]), np.array(y, float), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.diag([1e-3, 1, 1]), a.T @ (p - t) + ridge * np.array([1e-3, 1, 1]) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


_NAMES = ["total", "n_hits", "n_terms", "matched", "score"]


def _score(lexicon: Lexicon):
    def run(batches):
        machine = automaton(lexicon.patterns())
        for batch in batches:
            rows = []
            for _, part in text_runs(batch.column("text").to_pylist()):
                for text in fold(part):
                    words = max(0, text.count(" ") - 1)
                    total, n, matched = lexicon.hits(text, machine)
                    rows.append((total, n, words, matched, lexicon.score(total, words)))
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [*batch.schema.names, *_NAMES])

    return run


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Adds to docs(text, ...): total (of weights), n_hits, n_terms (words of the folded text), matched (entries) and
    score; columns of docs with these names are replaced, all others stay.

    A null or empty text has no hits and the score of none; a very long one is scored whole inside its row. Repeated rows
    score alike; ties do not arise; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop(*_NAMES)
    kinds = T.StructType([*rows.schema.fields, T.StructField("total", T.DoubleType()), T.StructField("n_hits", T.LongType()), T.StructField("n_terms", T.LongType()), T.StructField("matched", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_score(lexicon), kinds)
