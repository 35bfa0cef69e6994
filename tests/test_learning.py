"""Learning and retrieval jobs against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from barloom.operators import hybrid, learning
from barloom.sources.bars import BARS

from .conftest import SMALL


def test_every_bar_is_an_entry(spark):
    closes, want = defaultdict(list), {}
    for r in BARS.frame(spark, SMALL).orderBy("symbol", "ts").collect():
        closes[r["symbol"]].append(r["close"])
    for symbol, own in closes.items():
        for i, c in enumerate(own):
            for held in range(1, min(20, len(own) - 1 - i) + 1):
                move = own[i + held] / c - 1
                rule = "TARGET" if move >= 0.1 else "STOP" if move <= -0.1 else "TIME" if held == 20 else None
                if rule:
                    want[symbol, i + 1] = (rule, held)
                    break
    rows = learning.x04_first_exit(spark, SMALL).collect()
    assert {(r["symbol"], r["k0"]): (r["rule"], r["bars_held"]) for r in rows} == want and len(rows) == len(want)


def test_hybrid_search_cuts_neither_list(spark, tmp_path):
    draw = random.Random(5)
    docs = {i: [draw.choice([f"w{k}" for k in range(12)]) for _ in range(draw.choice([3, 10, 60]))] for i in range(150)}
    items = {0: ["w1", "w2", "w3"], 1: ["w4", "w4", "w5", "w9"]}
    spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(t for w in docs.values() for t in set(w))

    def vector(words):
        v = [0.0] * 32
        for t, n in Counter(words).items():
            h = hashlib.sha256(t.encode()).hexdigest()
            v[int(h[:8], 16) % 32] += n if int(h[8:10], 16) % 2 == 0 else -n
        norm = math.sqrt(sum(x * x for x in v))
        return [round(x / norm, 6) if norm else 0.0 for x in v]

    got = defaultdict(dict)
    for r in hybrid.f07_hybrid_search(spark, str(tmp_path)).collect():
        got[r["item_id"]][r["place"]] = r["score"]
    for item, terms in items.items():
        a = {i: sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in Counter(w).items() if t in terms) for i, w in docs.items()}
        q = vector(terms)
        b = {i: c for i, w in docs.items() if (c := sum(x * y for x, y in zip(q, vector(w), strict=True))) > 0.1}
        want = sorted((0.6 * a[i] / max(a.values()) + 0.4 * b.get(i, 0.0) / max(b.values()) for i in docs), reverse=True)[:10]
        assert [got[item][k] for k in range(1, 11)] == [round(x, 6) for x in want] or max(abs(got[item][k + 1] - x) for k, x in enumerate(want)) < 2e-6


@pytest.mark.parametrize("name", ["m06_scored", "m08_batch_inference", "m09_permutation"])
def test_training_table_is_made_once(spark, monkeypatch, name):
    """Model and scores read what was written, not the trades anew."""
    trained, fitted = [], learning.fitted
    monkeypatch.setattr(learning, "fitted", lambda train: trained.append(train) or fitted(train))
    result = learning.QUERIES[name](spark, SMALL)
    for df in (*trained, result):
        assert df.inputFiles() and not any("lineitem" in f for f in df.inputFiles())
    assert result.count() > 0 and len(trained) == 1
