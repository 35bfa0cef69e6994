"""Search, votes, valuation, weights and quality reports on small cases."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import bar_quality, ensemble, search, valuation

DAY = date(2024, 1, 1)


@pytest.fixture(scope="module")
def texts():
    draw = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(draw.choice(words, draw.integers(1, 60)))) for i in range(120)] + [(500, None), (501, ""), (None, "w1 w2"), (502, "zz yy")]
    queries = [(i, " ".join(draw.choice(words, 5))) for i in range(9)] + [(50, None), (51, "unknown"), (None, "w1")]
    return docs, queries


@pytest.mark.parametrize("bm25", [True, False])
def test_text_search_equals_a_loop(spark, texts, monkeypatch, bm25):
    monkeypatch.setattr(search, "BLOCK_TERMS", 12)  # several blocks
    docs, queries = texts
    got = search.text_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"), 4, bm25).collect()
    bags = {i: t.split() for i, t in docs if i is not None and t}
    mean = sum(map(len, bags.values())) / len(bags)
    want = set()
    for q, text in queries:
        if q is None or not text:
            continue
        scores = {}
        for i, bag in bags.items():
            x = 0.0
            for t in set(text.split()):
                tf, df = bag.count(t), sum(t in b for b in bags.values())
                if tf:
                    x += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean)) if bm25 else tf
            if x:
                scores[i] = round(x, 6)
        want |= {(q, i, scores[i], k + 1) for k, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:4])}
    assert {(r["item_id"], r["doc_id"], r["place"]) for r in got} == {(q, i, k) for q, i, _, k in want}
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(x for _, _, x, _ in want), abs=2e-6)


def test_each_text_is_split_once(spark, texts):
    docs, queries = texts
    plan = search.text_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # the search reads what was counted


def test_vectors_of_odd_shapes(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTORS", 2)
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in draw.normal(size=6)]) for i in range(60)] + [(100, None), (101, [1.0, 2.0]), (102, [0.0] * 6), (104, []), (None, [1.0] * 6)]
    got = search.vector_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 0.2, 3).collect()
    own = {i: np.array(v) for i, v in rows if i is not None and v and len(v) == 6 and any(v)}
    want = set()
    for q in (i for i in own if i % 10 == 0):
        c = {i: round(float(v @ own[q] / np.sqrt((v @ v) * (own[q] @ own[q]))), 6) for i, v in own.items() if i != q}
        want |= {(q, i, k + 1) for k, i in enumerate(sorted((i for i in c if c[i] > 0.2), key=lambda i: (-c[i], i))[:3])}
    assert {(r["query_id"], r["vec_id"], r["place"]) for r in got} == want
    assert search.vector_search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_votes_conflicts_and_decisions(spark):
    def votes(symbol, *given, stale=False):
        return [(symbol, DAY, "RANGE", s, d, x, c, stale) for s, d, x, c in given]

    rows = [
        *votes(1, ("STRATEGY", "LONG", 90.0, 80.0), ("INDICATOR", "LONG", 85.0, 70.0), ("ML", "LONG", 80.0, 60.0)),
        *votes(2, ("STRATEGY", "LONG", 90.0, 80.0), ("ML", "SHORT", 80.0, 60.0), ("INDICATOR", "LONG", None, None)),
        *votes(3, ("STRATEGY", "LONG", 90.0, 80.0), ("RISK", "REJECT", 90.0, 90.0), ("INDICATOR", "LONG", 90.0, 80.0)),
        *votes(4, ("NEWS", "LONG", 90.0, 80.0)),
        *votes(5, ("STRATEGY", "LONG", 90.0, 80.0), stale=True),
    ]
    found = ensemble.ranked(ensemble.consensus(spark.createDataFrame(rows, "symbol long, ts date, regime string, source string, direction string, score double, confidence double, stale boolean"), ensemble.regime_weights(spark))).collect()
    by = {r["symbol"]: r for r in found}
    assert (by[1]["decision"], by[1]["direction"], by[1]["agreement"], by[1]["place"]) == ("APPROVED", "LONG", 1.0, 1)
    assert by[2]["ml_technical"] and by[2]["directional"] and by[2]["conflict"] == 45 and by[2]["advice"] == "CONFLICTED"
    w = {r["source"]: r["weight"] for r in ensemble.regime_weights(spark).where("regime = 'RANGE'").collect()}
    assert sum(w.values()) == pytest.approx(1) and by[2]["score"] == pytest.approx((w["STRATEGY"] * 90 + w["ML"] * 20 + w["INDICATOR"] * 50) / (w["STRATEGY"] + w["ML"] + w["INDICATOR"]))
    assert by[3]["risk"] and by[3]["decision"] == "REJECTED" and by[3]["direction"] == "REJECT"
    assert (by[4]["score"], by[4]["agreement"], by[4]["voted"], by[4]["decision"]) == (50.0, 0.0, "UNKNOWN", "INSUFFICIENT_AGREEMENT")
    assert by[5]["stale"] and by[5]["decision"] == "WATCH_ONLY"


def test_multiples_and_bands(spark):
    items = ("market_value", "net_income", "equity", "enterprise_value", "ebitda", "revenue", "free_cash", "dividend")
    rows = [(1, DAY + timedelta(days=90 * i), 100.0, 10.0 + i, -5.0, 120.0, 1e-12, 50.0, 4.0 + i, None) for i in range(9)]
    df = spark.createDataFrame(rows, f"symbol long, period date, {', '.join(f'{c} double' for c in items)}")
    found = valuation.multiples(df)
    first = {r["metric"]: (r["value"], r["status"]) for r in found.where(F.col("period") == F.lit(DAY)).collect()}
    assert first["PE"] == (10.0, "OK") and first["PB"] == (-20.0, "WATCH") and first["EV_EBITDA"] == (None, "ZERO") and first["DIVIDEND_YIELD"] == (None, "INSUFFICIENT_DATA")
    by = {r["metric"]: r for r in valuation.bands(found).collect()}
    assert by["PE"]["status"] == "EXTREME_CHEAP" and by["PE"]["rank"] == pytest.approx(100 * 0.5 / 9) and by["FCF_YIELD"]["status"] == "EXTREME_CHEAP" and by["FCF_YIELD"]["rank"] == pytest.approx(100 * 0.5 / 9)
    assert by["PB"]["status"] == "WATCH" and by["PRICE_SALES"]["z"] == 0.0 and "EV_EBITDA" not in by
    assert valuation.bands(found.where(F.col("period") < F.lit(DAY + timedelta(days=400)))).where("status <> 'INSUFFICIENT_DATA'").count() == 0


def test_eight_weights(spark):
    rows = [("p", 1.0, 0.5, 0.1, 1.0), ("p", 3.0, -1.0, 0.3, 0.0), ("p", None, 0.5, 0.0, 0.5), (None, 2.0, None, None, None)]
    found = valuation.weights(spark.createDataFrame(rows, "p string, score double, confidence double, sd double, votes double"), "p").collect()
    own = [r for r in found if r["p"] == "p"]
    total = lambda c: sum(r[c] or 0 for r in own)
    assert all(total(f"w_{m}") == pytest.approx(1) for m in valuation.METHODS)
    two = next(r for r in own if r["score"] == 3.0)
    assert (two["w_equal"], two["w_score"], two["w_confidence"], two["w_consensus"]) == (pytest.approx(1 / 3), 0.75, 0.0, 0.0) and two["w_inverse_volatility"] == pytest.approx((1 / 0.3) / (1 / 0.3 + 10))
    alone = next(r for r in found if r["p"] is None)
    assert (alone["w_score"], alone["w_inverse_volatility"], alone["w_hybrid"]) == (1.0, None, 1.0)


def test_quality_of_bars(spark):
    good = [(1, DAY + timedelta(days=i), 10.0, 11.0, 9.0, 10.0, 5.0, i) for i in range(60)]
    bad = [(2, DAY, 10.0, 9.0, 11.0, 12.0, 0.0, 1), (2, DAY, None, 9.0, 8.0, -1.0, 0.0, 2), (2, DAY + timedelta(days=60), 10.0, 11.0, 9.0, 100.0, 0.0, 0)]
    df = spark.createDataFrame(good + bad, "symbol long, ts date, open double, high double, low double, close double, volume double, k int")
    found = bar_quality.findings(df, "k")
    assert {r["check"]: r["n"] for r in found.where("symbol = 2").collect()} == {
        "unsorted": 2, "repeated_stamp": 1, "null_open": 1, "negative_close": 1, "high_below_low": 1, "high_below_open": 1, "high_below_close": 2, "low_above_open": 1, "low_above_close": 1, "large_gap": 1, "extreme_return": 2, "zero_volume": 3, "few_rows": 3,
    }
    assert found.where("symbol = 1").collect() == []
    by = {r["symbol"]: (r["error"], r["warning"], r["score"]) for r in bar_quality.scores(df, found).collect()}
    assert by == {1: (0, 0, 100), 2: (9, 4, 2)}
    text = df.withColumn("close", F.col("close").cast("string")).drop("open")
    critical = bar_quality.findings(text)
    assert {r["check"] for r in critical.where("severity = 'CRITICAL'").collect()} == {"missing_column_open", "not_numeric_close"}
    assert {r["score"] for r in bar_quality.scores(text, critical).where("symbol = 1").collect()} == {20}
    assert bar_quality.findings(df.where("false")).collect() == []


def test_imports_sources_and_columns(spark):
    df = spark.createDataFrame([(1, "a", " "), (1, "a", " "), (1, "b", None), (None, "c", "x")], "id int, k string, v string")
    got = {r["finding"]: r["n"] for r in bar_quality.import_findings(df, ["id"]).collect()}
    assert got == {"rows": 4, "repeated_row": 1, "repeated_key": 2, "no_key": 1, "null_id": 1, "null_k": 0, "blank_k": 0, "null_v": 1, "blank_v": 2}
    a = spark.createDataFrame([(1, DAY, 10.0), (1, DAY + timedelta(days=1), None), (2, DAY, 5.0)], "symbol long, ts date, close double")
    b = spark.createDataFrame([(1, DAY, 11.0), (1, DAY + timedelta(days=1), 3.0), (3, DAY, 5.0)], "symbol long, ts date, close double")
    assert {tuple(r) for r in bar_quality.source_comparison(a, b).collect()} == {(1, 2, 0, 0, 1, 0.1, 1), (2, 0, 1, 0, 0, None, 0), (3, 0, 0, 1, 0, None, 0)}
    f = spark.createDataFrame([(1, DAY, 1.0, None, "7"), (2, DAY + timedelta(days=9), 2.0, None, "x")], "id int, day date, a double, b double, c string")
    by = {r["column"]: (r["null_ratio"], r["outside"], r["is_constant"], r["days_old"], r["score"]) for r in valuation.frame_quality(f, ["id"], "day", F.lit("2024-02-15").cast("date"), limits={"a": (0.0, 1.5)}).collect()}
    assert by == {"a": (0.0, 1, False, 36, 85), "b": (1.0, 0, True, None, 65), "c": (0.5, 0, True, 45, 65)}


def test_rows_of_one_stamp_are_compared_in_the_order_of_their_places(spark):
    day = [DAY + timedelta(days=i) for i in range(3)]
    rows = [(1, day[0], 1, 100.0), (1, day[1], 2, 5000.0), (1, day[1], 1, 100.0), (1, day[2], 1, 5000.0)]
    df = spark.createDataFrame(rows, "symbol long, ts date, place int, close double").coalesce(1)
    for given in (df, df.orderBy(F.desc("close"), "ts").coalesce(1), df.orderBy("close", "ts").coalesce(1)):
        found = bar_quality.findings(given, most_return=20.0, then=["place"]).where("check = 'extreme_return'").collect()
        assert [r["n"] for r in found] == [1]  # 100, 100, 5000, 5000


def test_short_values_are_rounded_as_doubles(spark):
    row = spark.range(1).select(F.lit(-0.0324415).alias("x")).select(valuation._digits(F.col("x"), 6).alias("own"), F.round("x", 6).alias("decimal")).first()
    assert (row["own"], row["decimal"]) == (-0.032441, -0.032442)
    assert valuation._rounded(spark.range(1).select(F.lit(-0.0324415).alias("x"))).first()["x"] == -0.032441
