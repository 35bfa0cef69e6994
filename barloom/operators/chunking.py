"""Chunks of texts by sentences under a budget of tokens, with an overlap of whole sentences."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import read

BUDGET, OVERLAP = 800, 100  #: tokens of a chunk, and of the sentences that the next one repeats, at most
_WORD = re.compile(r"\w+")
_BREAK = re.compile(r"(?<=[.!?])\s+")


def tokens_of(words: int) -> int:
    """Tokens of so many words, estimated: a word is three quarters of a token's worth."""
    return int(words / 0.75) + 1


def packed(sizes: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """Runs (first, last) of sentences of the given sizes: a run takes sentences while their sum stays within the budget,
    one at least; the next run starts with those at its end that fit into the overlap."""
    out, start, held = [], 0, 0
    for k, size in enumerate(sizes):
        if held + size > budget and k > start:
            out.append((start, k - 1))
            held, again = 0, k
            while again > start and held + sizes[again - 1] <= overlap:
                again -= 1
                held += sizes[again]
            start = again
        held += size
    return [*out, (start, len(sizes) - 1)] if sizes else out


def _chunks(budget: int, overlap: int):
    def cut(text: str) -> list[tuple]:
        words = len(_WORD.findall(text))
        if tokens_of(words) <= budget:
            return [(text, 0, 0, words)] if text else []
        sentences = [s for s in map(str.strip, _BREAK.split(text)) if s]
        counts = [len(_WORD.findall(s)) for s in sentences]
        runs = packed([tokens_of(n) for n in counts], budget, overlap)
        return [(" ".join(sentences[a : z + 1]), a, z, sum(counts[a : z + 1])) for a, z in runs]

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = cut(text or "")
                ids += [k] * len(found)
                rows += [(i, *c, tokens_of(c[3])) for i, c in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "chunk", "chunk_text", "first_sentence", "last_sentence", "n_words", "tokens"])

    return run


def sentence_chunks(docs: DataFrame, budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, chunk, chunk_text, first_sentence, last_sentence, n_words, tokens). A text within the
    budget is one chunk as it is; a longer one is cut behind `.`, `!` and `?` with white space after them, and sentences are
    joined by one space. A sentence over the budget is a chunk of its own. Null and empty texts have no chunk; very long
    texts are cut whole; repeated rows are cut each for itself; other columns are not read."""
    if not 0 <= overlap < budget:
        raise ValueError("an overlap is smaller than the budget")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_chunks(budget, overlap), f"doc_id {kind}, chunk int, chunk_text string, first_sentence int, last_sentence int, n_words long, tokens long")


def f03_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_chunks(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "chunk", "first_sentence", "last_sentence", "n_words", "tokens", F.md5("chunk_text").alias("text_md5"))


QUERIES = {"f03_sentence_chunks": f03_sentence_chunks}
#: The same runs as a recursion over sentences, one of every text at a time; words are letters, digits and underscores.
_WORDS = lambda t: f"len(regexp_extract_all({t}, '[\\pL\\pN_]+'))"
_TOKENS = lambda n: f"CAST(floor({n} / 0.75) AS BIGINT) + 1"
ORACLES = {
    "f03_sentence_chunks": f"""WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS('text')} AS n FROM documents WHERE text <> ''),
parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \\t\\n\\r\\f\\v')), lambda x: x <> '') AS s FROM d WHERE {_TOKENS('n')} > {BUDGET}),
one AS (SELECT doc_id, unnest(s) AS t, unnest(range(1, len(s) + 1)) AS k FROM parts),
sized AS MATERIALIZED (SELECT doc_id, k, t, {_WORDS('t')} AS n, {_TOKENS(_WORDS('t'))} AS z FROM one),
summed AS MATERIALIZED (SELECT *, sum(z) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM sized),
r AS (
  SELECT doc_id, 1::BIGINT AS k, 1::BIGINT AS a, p, NULL::BIGINT AS told_a FROM summed WHERE k = 1 UNION ALL
  SELECT q.doc_id, q.k, CASE WHEN over THEN (SELECT coalesce(min(m.k), q.k) FROM summed m WHERE m.doc_id = q.doc_id AND m.k >= q.a AND m.k < q.k AND q.prev - m.p + m.z <= {OVERLAP}) ELSE q.a END, q.p, CASE WHEN over THEN q.a END
  FROM (SELECT s.doc_id, s.k, r.a, s.p, r.p AS prev, s.p - (SELECT x.p - x.z FROM summed x WHERE x.doc_id = r.doc_id AND x.k = r.a) > {BUDGET} AS over FROM r JOIN summed s ON s.doc_id = r.doc_id AND s.k = r.k + 1) q),
runs AS (SELECT doc_id, told_a AS a, k - 1 AS z FROM r WHERE told_a IS NOT NULL UNION ALL SELECT doc_id, arg_max(a, k), max(k) FROM r GROUP BY doc_id),
cut AS (SELECT runs.doc_id, a, runs.z, sum(n) AS n, string_agg(t, ' ' ORDER BY k) AS t FROM runs JOIN sized ON sized.doc_id = runs.doc_id AND k BETWEEN a AND runs.z GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY z) - 1 AS INT) AS chunk, CAST(a - 1 AS INT) AS first_sentence, CAST(z - 1 AS INT) AS last_sentence, CAST(n AS BIGINT) AS n_words, {_TOKENS('n')} AS tokens, md5(t) AS text_md5 FROM cut
UNION ALL SELECT doc_id, 0, 0, 0, n, {_TOKENS('n')}, md5(text) FROM d WHERE {_TOKENS('n')} <= {BUDGET}""",
}
