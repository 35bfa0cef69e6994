"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate, hilbert_shards, language_id, license_scan, minhash_dedup, packing, quality_model, quality_rules, token_files, toxicity
from barloom.llm.common import held_out

from .helpers import clashing, empty, odd, odd_rows

N = len(odd_rows())


def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog near the river"), (2, None), (None, "x"), (3, " "), (4, "striking thirteen")], "item_id long, text string")


def run_toxicity(spark, docs):
    return toxicity.score_toxicity(docs, toxicity.fit(docs, labels(spark), held_out(F.col("doc_id"), 5, 0)))


def run_quality(spark, docs):
    return quality_model.score_quality(docs, quality_model.fit(docs, labels(spark), held_out(F.col("doc_id"), 5, 0)))


OPERATORS = {
    "dedup": lambda s, d: minhash_dedup.near_duplicates(d),
    "rules": lambda s, d: quality_rules.quality_rules(d),
    "toxicity": run_toxicity,
    "quality": run_quality,
    "license": lambda s, d: license_scan.license_scan(d),
    "benchmark": lambda s, d: decontaminate.decontaminate(d, bench(s)),
    "shards": lambda s, d: hilbert_shards.hilbert_shards(d),
    "tokens": lambda s, d: token_files.token_files(s, d, public_tokenizers.path("word_bpe_49k.json")),
    "language": lambda s, d: language_id.identify(d, held_out(F.col("doc_id"), 4, 2)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    for docs in (odd(spark), clashing(spark)):
        assert OPERATORS[name](spark, docs).count() == N


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).collect() == []


def test_packing_edges(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for docs in (odd(spark), clashing(spark)):
        assert packing.pack(docs, path).where("piece = 0").count() == N
    assert packing.pack(empty(spark), path).collect() == []


def test_defined_results(spark):
    by_id = lambda df, *c: {(r["doc_id"], *(r[x] for x in c)) for r in df.collect()}
    dedup = by_id(minhash_dedup.near_duplicates(odd(spark)), "n_shingles", "component_id", "kept")
    assert {(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (7, 1, 7, True)} <= dedup
    assert {(r[0], r[2], r[3]) for r in dedup if r[0] in (1, 2)} == {(1, 1, True), (2, 1, False)}
    assert [(r[2], r[3]) for r in dedup if r[0] is None] == [(None, True)]
    found = by_id(language_id.identify(odd(spark), held_out(F.col("doc_id"), 4, 2)), "lang_pred", "score")
    assert {(3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0), (9, "und", 0.0)} <= found
    scan = by_id(license_scan.license_scan(odd(spark)), "n_words", "first_word", "labels", "score")
    assert (3, 0, None, "", 0.0) in scan
    sizes = by_id(hilbert_shards.hilbert_shards(odd(spark)), "size", "text_crc32", "law")
    assert {(3, 1, 0, "bytes"), (4, 1, 0, "bytes")} <= sizes


def test_models_without_labels(spark):
    none = labels(spark).where("false")
    lexicon = toxicity.fit(odd(spark), none, F.lit(False))
    assert toxicity.score_toxicity(odd(spark), lexicon).count() == N
    machine = quality_model.fit(odd(spark), none, F.lit(False))
    assert {r["score"] for r in quality_model.score_quality(odd(spark), machine).collect()} == {0.5}


INNER = ("_words", "_lines", "_failed", "_worded", "given", "_runs", "_items", "_others", "row", "pid", "term")


@pytest.mark.parametrize("name", ["rules", "toxicity", "benchmark"])
def test_other_columns_keep_their_values(spark, name):
    """Columns of the names that operators use inside, of several types, come back as they went in."""
    kinds = (F.lit("mine"), F.create_map(F.lit("a"), F.col("doc_id")), F.array(F.lit(1), F.lit(None).cast("int")), F.struct(F.lit(2).alias("x")))
    docs = odd(spark).withColumns({c: kinds[i % 4] for i, c in enumerate(INNER)})
    found = OPERATORS[name](spark, docs)
    own = [c for c in docs.columns if c != "text"]
    assert set(own) <= set(found.columns)
    assert sorted(map(str, found.select(own).collect())) == sorted(map(str, docs.select(own).collect()))


def test_one_row_of_equal_ids_with_columns_without_an_order(spark):
    import corpus_pipeline

    docs = odd(spark).withColumns({"meta": F.create_map(F.lit("k"), F.col("source")), "list": F.array("lang")})
    rows = corpus_pipeline.near_dedup(spark, docs, "")
    assert rows.columns == docs.columns
    ids = [r["doc_id"] for r in rows.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9] and ids.count(None) == 1
    again = corpus_pipeline.near_dedup(spark, docs.repartition(5).orderBy(F.desc("source")), "")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_groups_of_equal_texts_at_the_default(spark):
    """Groups of up to three tenths of a shard lie in one shard, shards are near equal, and cut groups are named."""
    rows = [(i, f"text {i} " * 20, "en", "a", i) for i in range(400)] + [(1000 + i, f"copy {i % 9} " * 12, "de", f"s{i % 3}", 5) for i in range(45)] + [(2000 + i, "hot " * 25, "fr", "b", 1) for i in range(200)]
    found = hilbert_shards.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    text = {r[0]: r[1] for r in rows}
    shards: dict = {}
    for r in found:
        shards.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    total = sum(r["size"] for r in found)
    sizes = [sum(r["size"] for r in found if r["shard"] == k) for k in range(16)]
    assert all(len(s) == 1 for t, s in shards.items() if not t.startswith("hot")) and len(shards["hot " * 25]) > 3
    assert all(r["group_cut"] == (len(shards[text[r["doc_id"]]]) > 1) for r in found)
    assert all(abs(16 * s / total - 1) < 0.31 for s in sizes)
