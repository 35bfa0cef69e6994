from __future__ import annotations

import re
import shutil

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SMALL

from .helpers import clashing, empty, odd

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FILTERS = corpus_pipeline.STAGES[:-1]


def low(text: str) -> str:
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_quality(text: str | None) -> str | None:
    """The text without failing lines, or None if the document goes."""
    text = text or ""
    words, seen = WORDS.findall(text), {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    if len(words) < 20 or 100 * len(repeated) > 30 * len(words):
        return None
    phrases = "accept (all )?cookies|all rights reserved|click here|cookie policy|enable javascript|forgot (your )?password|log in to|lorem ipsum|privacy policy|sign in to|sign up for|skip to (main )?content|subscribe to our|terms of (service|use)|this site uses cookies|we use cookies"
    kept, lost = [], 0
    for line in text.split("\n"):
        n, parts = len(WORDS.findall(line)), len(re.findall("[|»›•·]", line))
        fails = parts >= 2 and n <= 4 * (parts + 1) or n > 0 and 2 * len(re.findall("[#*$%&<>=_~^!?]{2,}", line)) >= n
        fails = fails or n >= 8 and not re.search("[.!?;:…。！？]", line) or n <= 30 and bool(re.search(phrases, line.lower()))
        if fails:
            lost += sum(map(len, WORDS.findall(line)))
        else:
            kept.append(line)
    return None if 100 * lost > 50 * sum(map(len, words)) else "\n".join(kept)


def brute_dedup(texts: dict[int, str]) -> set[int]:
    sets = {}
    for i, t in texts.items():
        w = low(t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and root[i] != root[j]:
                same = len(sets[i] & sets[j])
                if same and 100 * same >= 80 * len(sets[i] | sets[j]):
                    a, b = sorted((root[i], root[j]))
                    root = {k: a if r == b else r for k, r in root.items()}
    return {i for i in root if root[i] == i}


def brute_windows(text: str) -> set[tuple]:
    w = LETTERS.findall(low(text))
    n = min(10, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage after the learned one written out in plain Python, on the rows that the stage before kept."""
    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append([r.asDict() for r in docs.collect()])
    texts = [{r["doc_id"]: r["text"] for r in rows} for rows in seen[:-1]]
    judged = {i: brute_quality(t) for i, t in texts[0].items()}
    assert texts[1] == {i: t for i, t in judged.items() if t is not None}
    assert set(texts[2]) == brute_dedup(texts[1]) and texts[2].items() <= texts[1].items()
    windows = set().union(*(brute_windows(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()))
    sizes = {len(w) for w in windows}
    hit = {i for i, t in texts[2].items() if any(tuple(w[k : k + n]) in windows for w in [LETTERS.findall(low(t))] for n in sizes for k in range(len(w) - n + 1))}
    assert texts[3] == {i: t for i, t in texts[2].items() if i not in hit}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tokens = {i: 1 + len(library.encode(t, add_special_tokens=False).ids) for i, t in texts[3].items()}
    packed = {i: 0 for i in tokens}
    for r in seen[4]:
        packed[r["doc_id"]] += r["length"]
    assert packed == tokens
    ended = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in seen[3]:
        assert (r["lang"], r["source"]) == (ended[r["doc_id"]]["lang"], ended[r["doc_id"]]["source"])
        assert r["n_chars"] == (ended[r["doc_id"]]["n_chars"] if r["text"] == ended[r["doc_id"]]["text"] else len(r["text"]))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels and a benchmark beside the odd rows."""
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "nobody holds this passage of more than ten words at all, does anybody"), (2, None), (None, "word"), (3, "!")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    yield path
    shutil.rmtree(path)


EXPECTED = {
    "toxicity": [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    "quality_rules": [None, 1, 1, 2, 6],
    "near_dedup": [None, 1, 3, 4, 5, 6, 7, 8, 9],
    "decontamination": [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9],
}


@pytest.mark.parametrize(("name", "stage"), FILTERS)
def test_stages_on_odd_rows(spark, folder, name, stage):
    for docs in (odd(spark), clashing(spark)):
        rows = stage(spark, docs, folder).collect()
        assert sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i)) == EXPECTED[name]
        before = {tuple(r) for r in docs.collect()}
        assert all(tuple(r) in before for r in rows)  # every column as it was: no text of these loses a line
    assert stage(spark, clashing(spark), folder).columns == clashing(spark).columns


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(spark, folder, name, stage):
    assert stage(spark, empty(spark), folder).collect() == []


def test_rows_of_one_id(spark, folder):
    """Equal texts of an id are one document; the least of the other columns stays; different texts stay together."""
    rows = [(1, "a b c d e f", "en", "z", 3), (1, "a b c d e f", "en", "a", 4), (1, "other words stand in this text", "de", "b", 5), (2, "a b c d e f", "en", "q", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()) == [rows[1], rows[2]]


def test_lines_go_and_columns_stay(spark, folder):
    prose = "This is a good sentence with enough words in it to count as prose. Another one follows it right here, and it is fine."
    docs = spark.createDataFrame([(1, prose + "\nhome | news | about", "en", "a", 140)], "doc_id long, text string, lang string, kept string, n_chars int")
    assert [tuple(r) for r in corpus_pipeline.quality(spark, docs, folder).collect()] == [(1, prose, "en", "a", len(prose))]


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
