from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import substring_dedup as op

from .helpers import clashing, empty, odd, odd_rows


def by_brute_force(rows, window=op.WINDOW):
    first = defaultdict(lambda: float("inf"))
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                first[tuple(w[i : i + window])] = min(first[tuple(w[i : i + window])], d)
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["clean_text"]) for r in df.collect()), key=str)


def corpus(seed: int, n: int = 60) -> list[tuple]:
    draw = random.Random(seed)
    passages = [" ".join(draw.choice("alpha beta gamma delta eins zwei ß  x".split(" ")) + str(draw.randint(0, 30)) for _ in range(draw.choice((12, 13, 14, 55)))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(f"w{draw.randint(0, 10_000)}" for _ in range(draw.randint(0, 40))) for _ in range(3)] + draw.sample(passages, draw.randint(0, 3))
        draw.shuffle(parts)
        rows.append((draw.choice((i, i, i, 3)), draw.choice((" ", "\n", "\t\x0b ")).join(parts)))
    return rows + [(n + 1, "same word " * 400), (n + 2, "same word " * 9), (n + 3, "word same " * 30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(op.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == by_brute_force(rows)


def test_a_full_sketch_and_merges_in_rounds_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(op, "MOST_CELLS", 64)
    monkeypatch.setattr(op, "TOGETHER", 2)
    monkeypatch.setattr(op, "PIECE_BYTES", 2000)
    rows = corpus(3)
    assert found(op.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))) == by_brute_force(rows)


def test_sketch_bounds_every_count_from_above(spark):
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string").repartition(3)
    texts = [r["text"] for r in docs.collect()]
    width = 4096
    sketch = op.repeat_sketch(docs, width, op.WINDOW, 1)
    keys = op.window_keys(texts, op.WINDOW)[0]
    windows = list(map(tuple, keys.T.tolist()))
    seen = defaultdict(int)
    for k in windows:
        seen[k] += 1
    for row in range(op.ROWS):
        cells = op._cells(keys, row, width)
        set_bits = (sketch[row][cells >> 3] >> (7 - (cells & 7)).astype("uint8")) & 1
        assert all(bit for k, bit in zip(windows, set_bits, strict=True) if seen[k] > 1)
    assert 0 < sum(int(bin(x).count("1")) for x in sketch[0]) < width


def test_words_and_windows_of_any_length_have_keys():
    texts = ["a bb ccc " + "d" * n + " " + "é" * n for n in range(1, 40)] + ["", " \n", "one\x0btwo"]
    h, sizes = op.word_hashes(texts)
    words = [w for t in texts for w in t.encode().split()]
    assert sizes.tolist() == [len(t.encode().split()) for t in texts] and len(words) == h.shape[1]
    assert len(set(map(tuple, h.T.tolist()))) == len(set(words))
    keys, text, at = op.window_keys(["x " * 200, " ".join(map(str, range(200)))], 100)
    assert keys.shape[1] == 202 and len(set(map(tuple, keys.T.tolist()))) == 102 and at.tolist() == [*range(101), *range(101)]


def test_cells_are_packed_and_unpacked():
    draw = np.random.default_rng(7)
    for n in (0, 1, 1000, op.SEGMENT // 8, op.SEGMENT // 8 + 1, op.SEGMENT // 3):
        cells = np.sort(draw.choice(op.SEGMENT, n, replace=False))
        assert (op.unpacked(op.packed(cells)) == cells).all()
    assert op.unpacked(op.packed(np.array([0, 254, 509, 510, 765]))).tolist() == [0, 254, 509, 510, 765]


def test_spans_cover_what_went(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = op.remove_repeats(spark.createDataFrame([(1, a), (2, f"x y {a} z"), (3, a[3:])], "doc_id long, text string")).collect()
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in rows}
    assert spans == {1: [], 2: [(2, 62)], 3: [(0, 59)]}


def test_edges(spark):
    want = by_brute_force([r[:2] for r in odd_rows()])
    for docs in (odd(spark), clashing(spark).withColumns({c: F.lit("x") for c in ("hi", "lo", "at", "text_hash", "first", "clean_text")})):
        assert found(op.remove_repeats(docs)) == want
    assert op.remove_repeats(empty(spark)).collect() == []
    texts = spark.createDataFrame([("b", "w " * 20), ("a", "w " * 20)], "doc_id string, text string")
    assert [(r["doc_id"], r["n_removed"]) for r in op.remove_repeats(texts).orderBy("doc_id").collect()] == [("a", 0), ("b", 20)]
