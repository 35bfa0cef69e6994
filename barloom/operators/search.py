"""Keyword, BM25 and vector search: a stated set of queries, in blocks, against every row.

Each text is split into words once: what is written is its length and the counts of the words that some query holds. A
block of queries is then a table of word and query, which a task multiplies with a piece of documents, and a task gives on
the best rows of each query only, so no list of pairs is shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.clusters import kept
from barloom.operators.retrieval import BM25_SQL, K1, KEYWORD_SQL, VECTOR_SQL, B, query_terms, words_of
from barloom.sources.bars import read

BLOCK_TERMS = 500_000  #: pairs of query and word in a block of queries on average, dealt by hash
CELLS = 1_000_000  #: scores of documents x queries that a task holds at once
VECTORS = 2048  #: query vectors of a block


def best_of(query: np.ndarray, row: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `top` best of each query by score, then by row."""
    order = np.lexsort((row, -score, query))
    query = query[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < top
    return query[keep], row[order][keep], score[order][keep]


class Best:
    """The best rows of each query so far; candidates are merged when there are as many as CELLS."""

    def __init__(self, queries: int, top: int):
        self.top, self.least, self.parts, self.held = top, np.full(queries, -np.inf), [], 0

    def add(self, rows: np.ndarray, scores: np.ndarray, wanted: np.ndarray) -> None:
        """scores and wanted: rows x queries."""
        row, query = np.nonzero(wanted & (scores >= self.least))
        self.parts.append((query, rows[row], scores[row, query]))
        self.held += len(query)
        if self.held > CELLS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        empty = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        found = best_of(*(np.concatenate(c) for c in zip(empty, *self.parts, strict=True)), self.top)
        query, n = np.unique(found[0], return_counts=True)
        full = query[n == self.top]
        self.least[full] = found[2][np.searchsorted(found[0], full, "right") - 1]
        self.parts, self.held = [found], 0
        return found


def _counted(vocabulary):
    """doc_id, length, codes and counts of the known words, from doc_id and words."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            words = batch.column("w")
            n, length = len(words), words.value_lengths().to_numpy(zero_copy_only=False)
            coded = words.flatten().dictionary_encode()
            code_of = np.array([known.get(t, -1) for t in coded.dictionary.to_pylist()] or [-1])
            code = code_of[coded.indices.to_numpy()] if len(coded) else np.zeros(0, int)
            doc = np.repeat(np.arange(n), length)[code >= 0]
            pair, tf = np.unique(doc * max(1, len(known)) + code[code >= 0], return_counts=True)
            doc, code = np.divmod(pair, max(1, len(known)))
            at = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
            lists = (pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (code, tf))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(length.astype(np.int32)), *lists], ["doc_id", "length", "codes", "tf"])

    return run


def _scored(shared, top: int):
    """Best documents of a block: the terms' queries stand one after the other in `holders`, from first[code] on."""

    def run(batches):
        block = shared.value
        queries = len(block["ids"])
        best = Best(queries, top)
        size = max(1, CELLS // queries)
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                codes, tf = part.column("codes"), part.column("tf").flatten().to_numpy().astype(float)
                doc, code = np.repeat(np.arange(len(part)), codes.value_lengths().to_numpy(zero_copy_only=False)), codes.flatten().to_numpy()
                weight = tf
                if block["mean"] is not None:
                    length = part.column("length").to_numpy()[doc]
                    weight = block["idf"][code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / block["mean"]))
                n = (block["first"][1:] - block["first"][:-1])[code]
                which = np.repeat(block["first"][code] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
                cell = np.repeat(doc, n) * queries + block["holders"][which]
                scores = np.bincount(cell, np.repeat(weight, n), len(part) * queries).reshape(len(part), queries)
                best.add(part.column("doc_id").to_numpy(), np.round(scores, 6), scores > 0)
        query, row, score = best.merge()
        yield pa.RecordBatch.from_arrays([pa.array(block["ids"][query]), pa.array(row.astype(np.int64)), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


def _ranked(found: list[DataFrame], query: str, row: str, score: str, top: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(query).orderBy(F.desc(score), row))
    return reduce(DataFrame.union, found).withColumn("place", place).where(F.col("place") <= top)


def text_search(docs: DataFrame, queries: DataFrame, top: int = 10, bm25: bool = True) -> DataFrame:
    """docs(doc_id, text), queries(item_id, text), ids integers -> item_id, doc_id, score, place: the best documents of each
    query by BM25, or by the number of its words in the document. Document frequencies and lengths are counted over all
    documents; ties go by doc_id; rows without an id, queries without a word and documents without one of the query's are in
    no result. The words of all queries are sent to the tasks: the queries are a stated set, a block of them at a time."""
    spark = docs.sparkSession
    sought = query_terms(queries.where("item_id is not null"))
    blocks = max(1, -(-sought.count() // BLOCK_TERMS))
    words = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("w"))
    found = []
    for i in range(blocks):
        rows = sought.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()  # BLOCK_TERMS pairs on average
        if not rows:
            continue
        terms = sorted({r["term"] for r in rows})
        code = {t: k for k, t in enumerate(terms)}
        counted = kept(words.mapInArrow(_counted(spark.sparkContext.broadcast(code)), "doc_id long, length int, codes array<int>, tf array<int>"))
        ids = np.array(sorted({r["item_id"] for r in rows}))
        pairs = np.array(sorted((code[r["term"]], int(np.searchsorted(ids, r["item_id"]))) for r in rows))
        block = {"ids": ids, "holders": pairs[:, 1], "first": np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), "mean": None}
        if bm25:
            n, mean = counted.where("length > 0").agg(F.count("*"), F.avg("length")).first()
            df = np.zeros(len(terms))
            for k, c in counted.select(F.explode("codes").alias("k")).groupBy("k").count().collect():  # a row for each word of the block
                df[k] = c
            block |= {"mean": mean or 1.0, "idf": np.log(1 + ((n or 0) - df + 0.5) / (df + 0.5))}
        found.append(counted.mapInArrow(_scored(spark.sparkContext.broadcast(block), top), "item_id long, doc_id long, score double"))
    if not found:
        return spark.createDataFrame([], "item_id long, doc_id long, score double, place int")
    return _ranked(found, "item_id", "doc_id", "score", top)


def _cosines(shared, least: float, top: int):
    def run(batches):
        ids, vectors = shared.value
        best, size = Best(len(ids), top), max(1, CELLS // len(ids))
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                own, wide = part.column("vec_id").to_numpy(), part.column("v").value_lengths().to_numpy(zero_copy_only=False)
                fits = wide == vectors.shape[1]
                rows = np.zeros((len(part), vectors.shape[1]))
                rows[fits] = part.column("v").filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, vectors.shape[1])
                norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
                with np.errstate(all="ignore"):
                    cosine = np.where(norm > 0, rows / norm, 0.0) @ vectors.T
                best.add(own, np.round(cosine, 6), (cosine > least) & (own[:, None] != ids[None, :]))
        query, row, score = best.merge()
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(row.astype(np.int64)), pa.array(score)], ["query_id", "vec_id", "cosine"])

    return run


def vector_search(vectors: DataFrame, every: int = 100, least: float = 0.1, top: int = 10) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, vec_id, cosine, place: the vectors whose id is divisible by `every` are the
    queries, a block of VECTORS at a time, against all others. Vectors that are null, of another length than the queries or
    zero have no cosine; cosines up to `least` are left out; ties go by vec_id."""
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")).alias("v"))
    chosen = rows.where((F.col("vec_id") % every == 0) & (F.size("v") > 0))
    blocks, found = max(1, -(-chosen.count() // VECTORS)), []
    for i in range(blocks):
        own = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").collect()  # VECTORS on average
        for wide in sorted({len(r["v"]) for r in own}):
            some = [r for r in own if len(r["v"]) == wide]
            given = np.array([r["v"] for r in some], float)
            norm = np.sqrt((given * given).sum(axis=1, keepdims=True))
            unit = np.divide(given, norm, out=np.zeros_like(given), where=norm > 0)
            shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in some]), unit))
            found.append(rows.mapInArrow(_cosines(shared, least, top), "query_id long, vec_id long, cosine double"))
    if not found:
        return spark.createDataFrame([], "query_id long, vec_id long, cosine double, place int")
    return _ranked(found, "query_id", "vec_id", "cosine", top)


def f04_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), bm25=False)
    return found.withColumn("score", F.col("score").cast("long"))


def f05_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def f06_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (f04_keyword_search, f05_bm25, f06_vector_search)}
ORACLES = {"f04_keyword_search": KEYWORD_SQL, "f05_bm25": BM25_SQL, "f06_vector_search": VECTOR_SQL}
