from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import spelling_variants as op

from .helpers import clashing, empty, odd, odd_rows


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(seed: int, letters: str, size: int) -> dict[str, int]:
    draw = random.Random(seed)
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(5, 8))) for _ in range(size)}
    for w in list(words)[: size // 2]:
        i = draw.randrange(len(w))
        words |= {w[:i] + draw.choice(letters) + w[i:], w[:i] + draw.choice(letters) + w[i + 1 :]}
    return {w: draw.choice((3, 3, 5, 7, 14, 30)) for w in words} | {"aaaaa": 9, "aaaaaa": 4, "aaaaaaa": 2, "é" * 6: 3, "é" * 5 + "a": 8}


def by_brute_force(n: dict[str, int]) -> dict:
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n}


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnop"])
def test_equals_brute_force(spark, letters):
    n = vocabulary(len(letters), letters, 150)
    rows = op.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows} == by_brute_force(n)
    assert len(rows) == len(n)


def test_a_long_chain_reaches_its_root(spark):
    n = {"abcdefgh"[:i] + "x" * (8 - i): 3 * 2**i for i in range(9)}
    rows = op.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {r["root"] for r in rows} == {"abcdefgh"}


def test_pivots_are_the_cheapest_disjoint_grams():
    draw = random.Random(5)
    for _ in range(200):
        prefix = [(draw.randint(0, 9), "ab", i) for i in sorted(draw.sample(range(12), 5))]
        got = op.pivots_of(prefix)
        costs = [a[0] + b[0] for a in prefix for b in prefix if b[2] - a[2] >= op.GRAM]
        assert got[1][2] - got[0][2] >= op.GRAM and got[0][0] + got[1][0] == min(costs)


def test_prefix_takes_equal_grams_whole():
    assert [g[2] for g in op.prefix_of("aaaaaaaa", np.ones(op.BUCKETS))] == list(range(7))


def counted(rows, slip):
    n: Counter = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def test_words_are_counted_over_whole_texts(spark):
    rows = [(i, "Straße WORDS words École naïveté abcde fghij ÉCOLE " * (i % 4) + "tail" * 20_000) for i in range(40)] + [(None, "words words words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for slip in (None, 3, 97):
        assert {r["word"]: r["n"] for r in op.word_counts(docs, slip=slip).collect()} == counted(rows, slip)


def test_edges(spark):
    want = counted([r[:2] for r in odd_rows()], 97)
    for docs in (odd(spark), clashing(spark)):
        assert {r["word"]: r["n"] for r in op.word_counts(docs, slip=97).collect()} == want
    assert op.spelling_variants(op.word_counts(empty(spark))).collect() == []
    few = spark.createDataFrame([(None, 3), ("abcd", 3), ("abcde", 3), ("abcdef", 6)], "word string, n long")
    assert {(r["word"], r["n_near"], r["root"]) for r in op.spelling_variants(few).collect()} == {(None, 0, None), ("abcd", 0, "abcd"), ("abcde", 1, "abcdef"), ("abcdef", 1, "abcdef")}
    with pytest.raises(ValueError):
        op.spelling_variants(few, ratio=1)
