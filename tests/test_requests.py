"""Indicators with parameters: one shuffle for a request, literal frames, one's own indicator."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from barloom.functions import indicators as ind
from barloom.functions.families import FAMILY_WINDOWS
from barloom.functions.indicators import request, request_in_one_pass, request_plan
from barloom.plans import arrays
from barloom.plans.layers import Source
from barloom.sources.bars import BARS

from .conftest import SMALL

SCHEMA = "symbol long, ts date, open double, high double, low double, close double, volume double"


def ramp(spark, n: int = 100):
    """The close climbs by one a day; a second symbol stands still."""
    day = dt.date(2020, 1, 1)
    rows = [(1, day + dt.timedelta(i), 98.0 + i, 105.0 + i, 95.0 + i, 100.0 + i, 10.0) for i in range(n)]
    return spark.createDataFrame(rows + [(2, r[1], 5.0, 5.0, 5.0, 5.0, 0.0) for r in rows], SCHEMA)


def test_a_request_shares_one_shuffle_and_one_sort(spark):
    plan = ind.request(BARS.frame(spark, SMALL), ind.WINDOWS)._jdf.queryExecution().optimizedPlan()
    text = ind.request(ramp(spark), ind.WINDOWS)._jdf.queryExecution().sparkPlan().toString()
    executed = ind.request(ramp(spark), ind.WINDOWS)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1 and executed.count("Sort [symbol") == 1 and "Window" in text and plan is not None


def test_ramp_and_flat(spark):
    wanted = {"a": ("sma", {"window": 10}), "b": ("bands", {"window": 20}), "r": ("roc", {"window": 1}), "x": ("rsi", {"window": 5}), "t": ("atr", {"window": 3}), "z": ("zscore", {"window": 4}), "k": ("stochastic", {})}
    rows = {(r["symbol"], r["ts"].toordinal() - dt.date(2020, 1, 1).toordinal()): r for r in ind.request(ramp(spark), wanted).collect()}
    assert rows[1, 0]["a"] == 100 and rows[1, 50]["a"] == 145.5 and rows[1, 18]["b_mid"] is None and rows[1, 19]["b_mid"] == 109.5
    assert abs(rows[1, 19]["b_upper"] - (109.5 + 2 * (sum((i - 9.5) ** 2 for i in range(20)) / 20) ** 0.5)) < 1e-9
    assert rows[1, 5]["x"] == 100 and rows[1, 4]["x"] is None and rows[1, 9]["t"] == pytest.approx(10)
    flat = rows[2, 60]
    assert (flat["a"], flat["r"], flat["x"], flat["t"], flat["z"], flat["k_k"]) == (5, 0, 50, 0, None, None)


@pytest.mark.parametrize("window", [1, 7, 33])
@pytest.mark.parametrize("kind", ["sma", "ema"])
def test_averages_by_hand(spark, kind, window):
    rows = [r[2] for r in ind.request(ramp(spark).where("symbol = 1"), {"y": (kind, {"window": window})}).orderBy("ts").collect()]
    closes, want, y = [100.0 + i for i in range(100)], [], None
    for i, c in enumerate(closes):
        y = c if y is None else y + 2 / (window + 1) * (c - y)
        want.append(y if kind == "ema" else sum(closes[max(0, i + 1 - window) : i + 1]) / min(window, i + 1))
    assert rows == pytest.approx(want)


def test_own_indicator_and_refusals(spark):
    @ind.indicator
    def middle(column, factor=0.5):
        return [{column: f"low + {float(factor)} * (high - low)"}], [column]

    try:
        assert ind.request(ramp(spark, 1), {"m": ("middle", {"factor": 0.25})}).where("symbol = 1").first()["m"] == 97.5
        assert ind.request(ramp(spark, 1), {"d": ("ma_distance", {"kind": "ema", "window": 3})}).where("symbol = 1").first()["d"] == 0
    finally:
        del ind.INDICATORS["middle"]
    with pytest.raises(KeyError):
        ind.request(ramp(spark, 1), {"m": ("middle", {})})
    with pytest.raises(ValueError, match="window"):
        ind.request(ramp(spark, 1), {"m": ("sma", {"window": 0})})


def test_bundles_name_indicators(spark):
    for bundle in ind.BUNDLES.values():
        assert ind.request(ramp(spark, 30), bundle).count() == 60


def test_one_pass_over_arrays_equals_the_windows(spark):
    """Short and long symbols, nulls, ties, flat bars, pieces of few rows."""
    draw = random.Random(7)
    rows = []
    for symbol, n in ((1, 1), (2, 3), (3, 70), (None, 12), (4, 41)):
        for i in range(n):
            low, high = sorted(round(draw.uniform(1, 9), 1) for _ in range(2))
            close = None if draw.random() < 0.05 else draw.choice([low, high, (low + high) / 2])
            rows.append((symbol, i, draw.choice([low, high]), high, high if draw.random() < 0.1 else low, close, float(draw.randrange(0, 4))))
    bars = spark.createDataFrame(rows, "symbol long, ts int, open double, high double, low double, close double, volume double").repartition(3)
    plan = request_plan(Source(lambda *_: bars, ""), FAMILY_WINDOWS)
    found = request(bars, FAMILY_WINDOWS)
    want = found.selectExpr(*(f"round({c}, 6) AS {c}" if k == "double" else c for c, k in found.dtypes))
    key = lambda r: (r["symbol"] is None, r["symbol"] or 0, r["ts"])
    for rows_at_once in (5, 10_000):
        got = arrays.over_symbols(bars, plan.layers, plan.out, dict(found.dtypes), 6, rows_at_once)
        assert got.dtypes == want.dtypes and sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    one = request_in_one_pass(bars, FAMILY_WINDOWS, 6)
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and sum(x.strip(" :+-*()0123456789").startswith("Window ") for x in text.split("\n")) <= 1
    assert sorted(one.collect(), key=key) == sorted(want.collect(), key=key) and request_in_one_pass(bars.where("false"), FAMILY_WINDOWS, 6).collect() == []
    assert not arrays.supported(request_plan(Source(lambda *_: bars, ""), {"v": ("volatility", {})}).layers)  # a deviation stays with the engine
    other = request_in_one_pass(bars, {"v": ("volatility", {"window": 5})}, 3)
    assert "MapInArrow" not in other._jdf.queryExecution().executedPlan().toString() and other.count() == len(rows)


def test_rounding_of_arrays_is_the_engines(spark):
    draw = random.Random(8)
    values = [draw.uniform(-1, 1) * 10 ** draw.randrange(-8, 14) for _ in range(2000)] + [k / 2 / 10**6 for k in range(-60, 60)] + [0.0, -0.0, 1e300, float("inf"), float("nan"), 1.0000005, 2.5e-7, 5e-7, 4503599627.3704965]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").selectExpr("round(v, 6)").collect()]
    got = arrays.half_up(np.array(values), 6)
    assert [str(x + 0.0) for x in got.tolist()] == [str(x + 0.0) for x in want]
