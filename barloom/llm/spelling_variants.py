"""Spelling variants of one edit by pivotal grams.

If one edit makes one word of another, of two disjoint grams of the first at least one stands in the second, moved by one
place at most. Grams have one order, rare ones first; a word's prefix is its first GRAM * EDITS + 1 grams in that order
and its pivots are disjoint grams of the prefix. Of two words within an edit, the one whose prefix ends earlier has a pivot
that stands in the other's prefix, so pivots need only meet prefixes. A surviving gram leaves the edit on one side of it,
so the other side is equal, and so is one half of the side with the edit: both go into the key of the index, which leaves
few pairs to verify and no bucket that holds all words of a common gram.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import cut, small_batches

GRAM, EDITS = 2, 1
PREFIX = GRAM * EDITS + 1
LEAST = 5  #: code points of a word; shorter ones have too few grams
BUCKETS = 1 << 16  #: of gram frequencies, so that the table that tasks get is as large for any alphabet
FLUSH = 200_000  #: distinct words that a task counts before it hands them on
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")
_MOD, _BASE = (1 << 61) - 1, 1_000_003


def _counted(words: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])


def _count(slip: int | None):
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = Counter(_RUN.findall((text or b"").lower().decode()))
                if slip:
                    start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        counts[word] += n
                else:
                    counts.update(found)
                if len(counts) >= FLUSH:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    return run


def word_counts(docs: DataFrame, least: int = 3, slip: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> (word, n): maximal runs of Latin letters (A-Z lower-cased) of at least LEAST code points that
    occur at least `least` times in all. With `slip`, a run loses the code point h % length where slip divides h, the
    crc32 of `<doc_id>:<run>`: typing slips at a known rate.

    Null, empty and wordless texts have no words; very long texts are counted whole, in pieces of FLUSH distinct words;
    a null id is the text 'null' in h; repeated rows count each for itself; an empty table gives an empty one; other
    columns, whatever their names, are not read."""
    small_batches(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(_count(slip), "word string, n long").where(F.char_length("word") >= LEAST)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _bucket(gram: str) -> int:
    return (ord(gram[0]) * 0x9E37 + ord(gram[1]) * 0x85EB) % BUCKETS


def _tally(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for word in batch.column("word").to_pylist():
            for i in range(len(word) - 1):
                total[_bucket(word[i : i + GRAM])] += 1
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def gram_frequencies(words: DataFrame) -> np.ndarray:
    """How often grams of each bucket stand in the words: BUCKETS numbers for any table."""
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in words.select("word").mapInArrow(_tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def prefix_of(word: str, frequency) -> list[tuple]:
    """(frequency, gram, place) of the first PREFIX grams, and of all others equal to the last of them, by place."""
    grams = [(int(frequency[_bucket(g)]), g, i) for i in range(len(word) - 1) for g in (word[i : i + GRAM],)]
    last = sorted(grams)[PREFIX - 1][:2]
    return [g for g in grams if g[:2] <= last]


def pivots_of(prefix: list[tuple]) -> list[tuple]:
    """EDITS + 1 grams that do not overlap, of the least total frequency: best[j][k] is the cheapest choice of k of the
    first j grams, which leaves gram j out or takes it beside a choice among those that end before it."""
    none = (float("inf"), ())
    best = [[(0, ()), *[none] * (EDITS + 1)]]
    before = 0
    for j, gram in enumerate(prefix):
        while prefix[before][2] + GRAM <= gram[2]:
            before += 1
        row = [(0, ())]
        for k in range(1, EDITS + 2):
            cost, chosen = best[before][k - 1]
            row.append(min(best[j][k], (cost + gram[0], (*chosen, gram))))
        best.append(row)
    return list(best[-1][-1][1])


class Slices:
    """Hashes of slices of a word, each in one step."""

    def __init__(self, word: str):
        self.sums, self.powers = [0], [1]
        for c in word:
            self.sums.append((self.sums[-1] * _BASE + ord(c)) % _MOD)
            self.powers.append(self.powers[-1] * _BASE % _MOD)

    def __call__(self, start: int, end: int) -> int:
        return (self.sums[end] - self.sums[start] * self.powers[end - start]) % _MOD


def _keys(word: str, slices: Slices, gram: str, at: int, longer: int) -> set[int]:
    """Keys of a partner with `longer` more code points in which the gram survives: the edit lies left or right of the
    gram, the other side is equal, and so is the first or the last half (in the partner's length) of the edited side."""
    n, end, out = len(word), at + GRAM, set()
    for side, (start, stop) in enumerate(((0, at), (end, n))):
        own, there = stop - start, stop - start + longer
        if there < 0:
            continue
        equal = slices(end, n) if side == 0 else slices(0, at)
        place = at + longer if side == 0 else at
        first = there // 2
        for half, size in ((0, first), (1, there - first)):
            if size <= own:
                part = slices(start, start + size) if half == 0 else slices(stop - size, stop)
                out.add(xxhash.xxh3_64_intdigest(f"{gram} {place} {n + longer} {side} {half} {equal} {part}") - (1 << 63))
    return out


def _index(frequency):
    """Rows of both sides of the join: a word's pivots ask for partners, its prefix answers."""

    def run(batches):
        for batch in batches:
            keys, places, asks = [], [], []
            for row, word in enumerate(batch.column("word").to_pylist()):
                slices, prefix = Slices(word), prefix_of(word, frequency.value)
                ask = {k for _, gram, at in pivots_of(prefix) for d in range(-EDITS, EDITS + 1) for k in _keys(word, slices, gram, at, d)}
                answer = {k for _, gram, at in prefix for k in _keys(word, slices, gram, at, 0)}
                keys += [*ask, *answer]
                places += [row] * (len(ask) + len(answer))
                asks += [True] * len(ask) + [False] * len(answer)
            at = pa.array(places, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(asks, pa.bool_()), batch.column("word").take(at), batch.column("n").take(at)], ["key", "asks", "word", "n"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """words(word, n), distinct -> (a, a_n, b, b_n): each pair of words at one inserted, deleted or replaced code point,
    once, a < b. Words of fewer than LEAST code points and null ones are in no pair; an empty table gives none."""
    spark = words.sparkSession
    long = words.where(F.char_length("word") >= LEAST).select("word", F.col("n").cast("long").alias("n"))
    frequency = spark.sparkContext.broadcast(gram_frequencies(long))
    spread = long.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")  # a word makes some 40 rows
    rows = cut(spread.mapInArrow(_index(frequency), "key long, asks boolean, word string, n long"), "grams")
    ask = rows.where("asks").select("key", F.col("word").alias("x"), F.col("n").alias("x_n"))
    answer = rows.where("not asks").select("key", F.col("word").alias("y"), F.col("n").alias("y_n"))
    met = ask.join(answer, "key").where("x <> y")
    up = F.col("x") < F.col("y")
    pairs = met.select(*(F.when(up, one).otherwise(other).alias(name) for one, other, name in (("x", "y", "a"), ("x_n", "y_n", "a_n"), ("y", "x", "b"), ("y_n", "x_n", "b_n")) for one, other in ((F.col(one), F.col(other)),)))
    return pairs.distinct().where(F.levenshtein("a", "b", EDITS) == EDITS)


def _roots(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links(word, form) without cycles -> (word, root). Each round doubles the steps taken, so rounds grow with the
    logarithm of the longest chain, and a chain with that of the largest count."""
    at = cut(links.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "forms")
    while not at.where("open").isEmpty():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "forms")
    return at.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """words(word, n), distinct -> (word, n, n_near, form, form_n, root). form is the near word of the largest n (ties: the
    smallest in code-point order) where that is at least ratio times the word's own n, else null; root follows forms to
    the last, the word itself where there is none.

    Null words have no near words; very long words are compared whole; an empty table gives an empty one; other columns
    are not read."""
    if ratio < 2:
        raise ValueError("forms may run in circles where ratio is below 2")
    words = cut(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(words)
    sides = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    taken = F.col("best.less") <= -ratio * F.col("n")
    found = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")), "variants")
    roots = _roots(words.sparkSession, found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
