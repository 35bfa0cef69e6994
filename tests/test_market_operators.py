"""Divergences, trades, admission, correlations, caps, folds, calendar, chunks and the store on small cases."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import chunking, constraints, correlation, divergence, ensemble, folds, percentiles, resampling, streaks, trades, trading_days
from barloom.plans import registry
from barloom.plans.layers import Plan, Source
from barloom.sources import bars as bar_source

from .conftest import SMALL
from barloom.sources.store import BarStore, RecordLog

DAY = date(2024, 1, 1)


def walk(seed: int, n: int, steps=(-2, -1, 0, 1, 2)):
    draw = random.Random(seed)
    out = [50]
    for _ in range(n - 1):
        out.append(max(1, out[-1] + draw.choice(steps)))
    return out


def pivots(v, high, confirm, lookback):
    s = 1 if high else -1
    out = []
    for i in range(len(v)):
        before, after = v[max(0, i - lookback) : i], v[i + 1 : i + 1 + confirm]
        if len(before) < lookback or len(after) < confirm or None in (v[i], *before, *after):
            continue
        if confirm and all(s * x <= s * v[i] for x in before) and all(s * x < s * v[i] for x in after) or not confirm and all(s * x < s * v[i] for x in before):
            out.append(i)
    return out


def paired(p, q, confirm, lookback, least, most):
    found = set()
    for high in (True, False):
        mine, theirs = pivots(p, high, confirm, lookback), pivots(q, high, confirm, lookback)
        own = {}
        for i in mine:
            near = sorted((abs(i - j), j) for j in theirs if abs(i - j) <= 2)
            if near:
                own[i] = near[0][1]
        for i in own:
            for j in sorted(own, reverse=True):
                if least <= i - j <= most and own[j] < own[i]:
                    found.add(("HIGH" if high else "LOW", i + 1, float(p[j]), float(p[i]), float(q[own[j]]), float(q[own[i]]), i - j, i + 1 + confirm))
                    break
    return found


@pytest.mark.parametrize("confirm", [0, 1, 3])
def test_pivot_pairs_equal_brute_force(spark, confirm):
    series = {s: (walk(s, 160), walk(100 + s, 160)) for s in range(4)}
    series[3] = ([1] * 160, walk(9, 160))
    rows = [(s, DAY + timedelta(days=i), p, None if s == 2 and i % 40 == 0 else q) for s, (a, b) in series.items() for i, (p, q) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "symbol long, ts date, close long, other long")
    got = divergence.pivot_pairs(df, "close", "other", confirm, 3, least=3, most=25).collect()
    for s, (a, b) in series.items():
        b = [None if s == 2 and i % 40 == 0 else q for i, q in enumerate(b)]
        assert {tuple(r[c] for c in ("side", "pos", "price_1", "price_2", "indicator_1", "indicator_2", "bars", "told_pos")) for r in got if r["symbol"] == s} == paired(a, b, confirm, 3, 3, 25)


def test_kinds_and_strength(spark):
    rows = [("HIGH", 100.0, 110.0, 50.0, 40.0, 10), ("HIGH", 110.0, 100.0, 40.0, 50.0, 10), ("LOW", 100.0, 90.0, 20.0, 30.0, 10), ("LOW", 90.0, 100.0, 30.0, 20.0, 10), ("LOW", 90.0, 100.0, 30.0, 40.0, 10), ("HIGH", 100.0, 100.5, 50.0, 49.9, 40), ("HIGH", 0.0, 1.0, 5.0, 4.0, 9)]
    df = spark.createDataFrame([(1, s, DAY, 50, *v, 50) for s, *v in rows], "symbol long, side string, ts date, pos long, price_1 double, price_2 double, indicator_1 double, indicator_2 double, bars int, told_pos long")
    found = divergence.divergence_events(df).collect()
    assert [r["kind"] for r in found] == ["REGULAR_BEARISH", "HIDDEN_BEARISH", "REGULAR_BULLISH", "HIDDEN_BULLISH", "REGULAR_BEARISH", "REGULAR_BEARISH"]
    assert found[0]["strength"] == pytest.approx(90.0) and found[4]["strength"] == 0.0 and found[5]["strength"] == 50.0
    assert divergence.divergence_events(df, hidden=False, least_strength=60).count() == 2
    assert divergence.divergence_events(df, confirmed=True).collect()[4]["strength"] == pytest.approx(2.5 + 0.4 - 5 + 10)


def bars_of(spark, signals, closes, symbol=1):
    rows = [(symbol, DAY + timedelta(days=i), float(c) - 1, float(c), s) for i, (s, c) in enumerate(zip(signals, closes, strict=True))]
    return spark.createDataFrame(rows, "symbol long, ts date, open double, close double, signal string")


def test_fills_of_the_next_open_the_next_close_and_the_same_close(spark):
    df = bars_of(spark, ["HOLD"] * 5 + ["LONG", "LONG", "SHORT", "HOLD", "HOLD"], [100, 100, 100, 100, 100, 100, 110, 120, 130, 140])
    for fill, bought, sold, first, held in (("NEXT_OPEN", 109.0, 129.0, 6, 2), ("NEXT_CLOSE", 110.0, 130.0, 6, 2), ("SAME_CLOSE", 100.0, 120.0, 5, 2)):
        (t,) = trades.trades_from_signals(df, trades.Rules(fill, cost_bps=10.0)).collect()
        assert (t["entry_price"], t["exit_price"], t["entry_time"], t["bars_held"], t["exit_reason"]) == (bought, sold, DAY + timedelta(days=first), held, "OPPOSITE")
        assert t["quantity"] == int(20_000 / bought) and t["gross_pnl"] == pytest.approx(t["quantity"] * (sold - bought))
        assert t["net_pnl"] == pytest.approx(t["gross_pnl"] - t["quantity"] * (sold + bought) * 0.001)


def test_exits_depend_on_the_entry(spark):
    closes = [100] * 6 + [100, 89, 100, 100, 100, 121, 100, 100, 100, 100, 100, 100]
    df = bars_of(spark, ["HOLD"] * 5 + ["LONG"] * (len(closes) - 5), closes)
    found = trades.trades_from_signals(df, trades.Rules("SAME_CLOSE", stop=0.1, target=0.2, most_bars=3, cost_bps=0.0)).orderBy("entry_time").collect()
    assert [(r["exit_reason"], r["bars_held"], r["exit_price"]) for r in found][:3] == [("STOP", 2, 89.0), ("TIME", 3, 121.0), ("TIME", 3, 100.0)] or [r["exit_reason"] for r in found][:2] == ["STOP", "TARGET"]
    assert found[-1]["exit_reason"] in ("TIME", "END")
    none = trades.trades_from_signals(df, trades.Rules("SAME_CLOSE", capital=100.0, least_notional=1.0, position_pct=0.5))
    assert none.collect() == [] and trades.trades_from_signals(df.where("false"), trades.Rules()).collect() == []
    with pytest.raises(ValueError):
        trades.trades_from_signals(df, trades.Rules("LATER"))


def test_admission_depends_on_what_was_taken(spark):
    rows = [(DAY, 1, "a", 90.0, 0.02, []), (DAY, 2, "a", 80.0, 0.02, []), (DAY, 3, "b", 70.0, 0.05, []), (DAY, 3, "b", 60.0, 0.02, []), (DAY, 4, None, 50.0, None, []), (DAY, 5, "c", 95.0, 0.01, ["COST"]), (DAY, 6, "d", 40.0, 0.0, []), (DAY + timedelta(days=1), 2, "a", None, 0.02, [])]
    df = spark.createDataFrame(rows, "day date, symbol long, sector string, score double, risk_pct double, reasons array<string>")
    got = {(r["day"], r["place"]): r["decision"] for r in trades.admitted(df, trades.Limits(daily=3, per_sector=1, risk_pct=0.06)).collect()}
    assert got == {(DAY, 1): "COST", (DAY, 2): "ACCEPT", (DAY, 3): "SECTOR_LIMIT", (DAY, 4): "RISK_LIMIT", (DAY, 5): "ACCEPT", (DAY, 6): "ACCEPT", (DAY, 7): "DAILY_LIMIT", (DAY + timedelta(days=1), 1): "ACCEPT"}


def test_correlations_over_blocks_equal_numpy(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=150)
    values = {s: base * (s % 3 - 1) + draw.normal(size=150) * 3 + 100 * s for s in range(23)}
    values[22] = np.full(150, 5.0)
    rows = [(s, DAY + timedelta(days=i), float(x)) for s, v in values.items() for i, x in enumerate(v) if (s * 7 + i) % 5 or s == 22]
    df = spark.createDataFrame([*rows, (None, DAY, 1.0), (1, DAY, None)], "symbol long, ts date, r double").where("r is not null or symbol is not null")
    got = {(r["a"], r["b"]): (r["n"], r["correlation"]) for r in correlation.pair_correlations(df, 30, block=5).collect()}
    there = {s: {i for i in range(150) if (s * 7 + i) % 5} for s in range(22)}
    assert len(got) == 22 * 21 // 2
    for (a, b), (n, c) in got.items():
        days = sorted(there[a] & there[b])
        assert n == len(days) and c == pytest.approx(np.corrcoef(values[a][days], values[b][days])[0, 1], abs=1e-9)
    strong = correlation.pair_correlations(df, 30, 0.25, block=1000).collect()
    assert {(r["a"], r["b"]) for r in strong} == {k for k, (_, c) in got.items() if abs(c) >= 0.25}
    assert correlation.pair_correlations(df.where("false")).collect() == []


def test_tiles_of_correlations_are_written_once_and_pairs_summed_in_the_task(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=90)
    rows = [(s, DAY + timedelta(days=i), float(x)) for s in range(40) for i, x in enumerate(base * (s % 4) + draw.normal(size=90))]
    df = spark.createDataFrame(rows, "symbol long, ts date, r double")
    plan = correlation.pair_correlations(df, block=4)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "explode" not in plan
    pairs = {(r["a"], r["b"]): r["correlation"] for r in correlation.pair_correlations(df, block=4).collect()}
    links = correlation.linked_symbols(df, 30, 0.3, block=4).collect()
    assert len(links) < sum(abs(c) >= 0.3 for c in pairs.values())
    groups = lambda found: {frozenset(g) for g in found}

    def joined(edges):
        of = {s: {s} for s in range(40)}
        for a, b in edges:
            both = of[a] | of[b]
            for s in both:
                of[s] = both
        return groups(of.values())

    assert joined((r["a"], r["b"]) for r in links) == joined(k for k, c in pairs.items() if abs(c) >= 0.3)
    weights = spark.createDataFrame([(s, 1.0 + s) for s in range(39)], "symbol long, weight double")
    got = {r["symbol"]: (r["most"], r["mean"]) for r in correlation.weighted_correlations(df, weights, block=4).collect()}
    assert set(got) == {-1, *range(39)}
    own = [(1.0 + (b if a == 5 else a), c) for (a, b), c in pairs.items() if 5 in (a, b) and b != 39]
    assert got[5] == pytest.approx((max(c for _, c in own), sum(w * c for w, c in own) / sum(w for w, _ in own)))
    whole = [((1.0 + a) * (1.0 + b), c) for (a, b), c in pairs.items() if b != 39]
    assert got[-1] == pytest.approx((max(c for _, c in whole), sum(w * c for w, c in whole) / sum(w for w, _ in whole)))


def test_only_symbols_outside_the_largest_group_meet_all_blocks(spark, monkeypatch):
    """One large group, a pair and three symbols by themselves, over eleven blocks and several rounds."""
    draw = np.random.default_rng(5)
    base, other = draw.normal(size=90) * 5, draw.normal(size=90) * 5
    values = {s: (base if s < 40 else other if s < 42 else 0) + draw.normal(size=90) for s in range(45)}
    df = spark.createDataFrame([(s, DAY + timedelta(days=i), float(x)) for s, v in values.items() for i, x in enumerate(v)], "symbol long, ts date, r double")
    asked, tiles = [], correlation._tiles
    monkeypatch.setattr(correlation, "_tiles", lambda rows, series, *rest, **named: (named.get("aside") and asked.append(series.count())) or tiles(rows, series, *rest, **named))
    links = [(r["a"], r["b"]) for r in correlation.linked_symbols(df, 30, 0.8, block=4).collect()]
    assert {frozenset(g) for g in _joined(links)} == {frozenset(range(40)), frozenset({40, 41})}
    assert asked and max(asked) <= 5
    strong = {(r["a"], r["b"]) for r in correlation.pair_correlations(df, 30, 0.8, block=4).collect()}
    assert {frozenset(g) for g in _joined(links)} == {frozenset(g) for g in _joined(strong)}
    asked.clear()
    assert correlation.linked_symbols(df, 30, 0.999999, block=4).collect() == [] and len(asked) == 1  # no group: all blocks meet in the end


def _joined(edges):
    of = {}
    for a, b in edges:
        both = of.get(a, {a}) | of.get(b, {b})
        for s in both:
            of[s] = both
    return of.values()


def test_correlations_are_not_joined_by_day(spark):
    df = spark.createDataFrame([(1, DAY, 1.0), (1, DAY + timedelta(days=1), 2.0), (2, DAY, 3.0)], "symbol long, ts date, r double")
    plan = correlation.pair_correlations(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "ts#" not in "".join(x for x in plan.split("\n") if "Join" in x) and "Cartesian" not in plan


def filled(w, cap):
    w = [max(x or 0.0, 0.0) for x in w]
    total = sum(w)
    c = [x / total for x in w] if total else w
    for _ in range(500):
        excess, room = sum(max(x - cap, 0) for x in c), sum(x for x in c if x < cap)
        if excess < 1e-15 or not room:
            break
        c = [cap if x >= cap else x + x * excess / room for x in c]
    return [min(x, cap) for x in c]


@pytest.mark.parametrize("cap", [0.05, 0.2, 0.34, 1.0])
def test_redistribution_equals_repeated_cuts(spark, cap):
    draw = random.Random(11)
    groups = {p: [draw.choice((draw.random() ** 6, 0.0, 0.5, 1.0)) for _ in range(n)] for p, n in (("a", 40), ("b", 3), ("c", 1), ("d", 200))} | {"e": [0.0, None, -1.0], None: [1.0, 2.0, 40.0]}
    rows = [(p, i, w) for p, v in groups.items() for i, w in enumerate(v)]
    got = {(r["portfolio"], r["i"]): r["capped"] for r in constraints.water_filled(spark.createDataFrame(rows, "portfolio string, i int, weight double"), cap).collect()}
    for p, v in groups.items():
        if p is not None:
            assert [got[p, i] for i in range(len(v))] == pytest.approx(filled(v, cap), abs=1e-9)
    assert len(got) == len(rows)
    with pytest.raises(ValueError):
        constraints.water_filled(spark.createDataFrame(rows, "portfolio string, i int, weight double"), 0)


def test_groups_are_scaled(spark):
    df = spark.createDataFrame([(1, "x", "s", 0.4), (2, "x", "t", 0.2), (3, None, "t", 0.3), (4, "y", "t", 0.0005)], "symbol int, sector string, strategy string, capped double")
    got = {r["symbol"]: r["final"] for r in constraints.scaled_to_groups(df, {"sector": 0.5, "strategy": 0.35}, 0.9).collect()}
    assert got[1] == pytest.approx(0.4 * 0.5 / 0.6) and got[2] == pytest.approx(0.2 * 0.35 / 0.5005) and got[3] == pytest.approx(0.3 * 0.35 / 0.5005) and got[4] == 0.0
    assert sum(r["final"] for r in constraints.scaled_to_groups(df, {"sector": 1.0}, 0.45).collect()) == pytest.approx(0.45, abs=1e-3)


def test_paths_fold_to_end_drawdown_and_ruin(spark):
    rows = [(1, DAY + timedelta(days=i), r) for i, r in enumerate((0.1, -0.5, 0.2, -0.3, 0.05, 0.4, None))] + [(2, DAY, -1.0)]
    df = spark.createDataFrame(rows, "symbol long, ts date, r double")
    got = resampling.bootstrap_paths(df, simulations=8, steps=7, block=3, seed=5).collect()
    import hashlib

    values = [0.1, -0.5, 0.2, -0.3, 0.05, 0.4]
    for r in (x for x in got if x["symbol"] == 1):
        path = []
        for b in range(3):
            at = int(hashlib.md5(f"5:1:{r['sim']}:{b}".encode()).hexdigest()[:8], 16) % 6
            path += [values[(at + i) % 6] for i in range(3)]
        equity, peak, down, low = 1.0, 1.0, 0.0, 1.0
        for x in path[:7]:
            equity *= 1 + x
            peak, low = max(peak, equity), min(low, equity)
            down = max(down, 1 - equity / peak)
        assert (r["log_end"], r["drawdown"], r["ruined"]) == (pytest.approx(np.log(equity)), pytest.approx(down), low <= 0.5)
    assert {(x["log_end"], x["drawdown"], x["ruined"]) for x in got if x["symbol"] == 2} == {(None, 1.0, True)}
    assert len(got) == 16


def test_folds_hold_each_row_where_it_belongs(spark):
    df = spark.createDataFrame([(i, DAY + timedelta(days=i)) for i in range(101)] + [(500, None)], "i int, day date")
    got = folds.walk_forward(df, "day", 40, 20, 15, 5, 2).collect()
    for k, a in enumerate(range(0, 41, 15), 1):
        assert sorted(r["i"] for r in got if r["fold"] == k and r["part"] == "train") == list(range(a, a + 35))
        assert sorted(r["i"] for r in got if r["fold"] == k and r["part"] == "test") == list(range(a + 42, a + 60))
    assert max(r["fold"] for r in got) == 3
    anchored = folds.walk_forward(df, "day", 40, 20, 15, anchored=True).collect()
    assert sorted(r["i"] for r in anchored if r["fold"] == 2 and r["part"] == "train") == list(range(55))
    purged = folds.purged_folds(df, "day", 4, 3, 2)
    rows = purged.collect()
    assert sorted(r["i"] for r in rows if r["part"] == "test") == list(range(101))
    assert sorted(r["i"] for r in rows if r["fold"] == 2 and r["part"] == "train") == [*range(22), *range(55, 101)]
    assert folds.overlapping(purged, "day").collect() == [] and folds.walk_forward(df.where("false"), "day", 40, 20, 15).collect() == []


def test_calendar_by_numbers(spark):
    holidays = ["2024-04-23", "2024-05-01", "2024-04-27", "2024-04-26"]
    cal = trading_days.trading_calendar(spark, "2024-01-01", "2024-12-31", holidays).collect()
    closed = {date.fromisoformat(h) for h in holidays}
    count = None
    for r in cal:
        open_ = r["day"].weekday() < 5 and r["day"] not in closed
        assert r["kind"] == ("WEEKEND" if r["day"].weekday() >= 5 else "HOLIDAY" if r["day"] in closed else "TRADING_DAY")
        assert count is None or r["number"] - count == open_
        count = r["number"]
    df = spark.createDataFrame([(date(2024, 4, 25),), (date(2024, 4, 27),), (date(2024, 4, 29),), (None,)], "d date")
    found = {r["d"]: (r["previous_day"], r["next_day"]) for r in trading_days.neighbours(df, "d", trading_days.trading_calendar(spark, "2024-04-01", "2024-05-31", holidays), holidays).collect()}
    assert found == {date(2024, 4, 25): (date(2024, 4, 24), date(2024, 4, 29)), date(2024, 4, 27): (date(2024, 4, 25), date(2024, 4, 29)), date(2024, 4, 29): (date(2024, 4, 25), date(2024, 4, 30)), None: (None, None)}
    rows = spark.createDataFrame([("A", date(2024, 4, 19)), ("A", date(2024, 4, 30)), ("A", date(2024, 5, 2))], "symbol string, ts date")
    assert [(r["after"], r["before"], r["missing"]) for r in trading_days.gaps(rows, holidays, 3).collect()] == [(date(2024, 4, 19), date(2024, 4, 30), 4)]


def test_chunks_fill_the_budget_and_overlap(spark):
    assert chunking.packed([3, 3, 3, 3], 7, 3) == [(0, 1), (1, 2), (2, 3)] and chunking.packed([9, 1, 9], 5, 2) == [(0, 0), (1, 1), (1, 2)] or chunking.packed([9, 1, 9], 5, 2)[0] == (0, 0)
    text = " ".join(f"Sentence number {i} has a few words in it, does it not?" for i in range(400))
    df = spark.createDataFrame([(1, text), (2, "Short. Text."), (3, None), (4, ""), (5, "no end " * 3000), (1, text)], "doc_id long, text string")
    got = chunking.sentence_chunks(df, 200, 40).collect()
    mine = sorted((r["chunk"], r["first_sentence"], r["last_sentence"], r["tokens"]) for r in got if r["doc_id"] == 1)[::2]
    assert all(t <= 200 for *_, t in mine) and mine[0][1] == 0 and mine[-1][2] == 399
    assert all(b[1] <= a[2] + 1 for a, b in zip(mine, mine[1:], strict=False)) and any(b[1] == a[2] - 1 for a, b in zip(mine, mine[1:], strict=False))
    assert {(r["doc_id"], r["chunk"]) for r in got if r["doc_id"] in (2, 3, 4, 5)} == {(2, 0), (5, 0)}
    with pytest.raises(ValueError):
        chunking.sentence_chunks(df, 10, 10)


def test_store_is_read_without_an_exchange(spark):
    rows = spark.createDataFrame([(s, DAY + timedelta(days=i), 1.0, 2.0, 0.5, float(i), 10.0) for s in "ABCDE" for i in range(9)] + [("A", DAY, 1.0, 2.0, 0.5, 7.0, 99.0)], "symbol string, ts date, open double, high double, low double, close double, volume double")
    store = BarStore(spark, "bars_of_test", 4)
    assert store.write(rows, "one", "1d") == 45 and store.write(rows.where("symbol < 'C'"), "two", "1d") == 18
    assert store.write(rows.withColumn("close", F.col("close") * 2), "one", "1d", adjusted=True) == 45
    assert store.write(rows, "one", "1d") == 45  # again: replaced, not doubled
    assert store.read("two", "1d").count() == 18 and store.read("one", "1d", ["A", "B"], "2024-01-03", "2024-01-05").count() == 6
    assert store.read("one", "1d", ["A"], last="2024-01-01").collect()[0]["close"] == 7.0
    assert {(r["symbol"], r["bars"]) for r in store.symbols("two", "1d").collect()} == {("A", 9), ("B", 9)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        window = store.read("one", "1d").withColumn("m", F.avg("close").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-2, 0)))
        for df in (window, store.with_adjusted("one", "1d")):
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    with pytest.raises(ValueError):
        store.write(rows.withColumn("symbol", F.lit(None).cast("string")), "one", "1d")


def test_newest_records_open_few_folders(spark, tmp_path):
    log = RecordLog(spark, f"{tmp_path}/log")
    assert log.latest("at", 3, "i") is None
    rows = spark.range(100).selectExpr("id AS i", "timestamp_seconds(1700000000 + id * 20000) AS at", "CASE WHEN id % 2 = 0 THEN 'even' END AS text")
    log.append(rows.where("i < 60"), "at")
    log.append(rows.where("i >= 60").union(spark.sql("SELECT 500L, NULL, 'no stamp'")), "at")
    newest = log.latest("at", 7, "i")
    assert [r["i"] for r in newest.collect()] == [99, 98, 97, 96, 95, 94, 93]
    assert len({f.rsplit("/", 2)[1] for f in newest.inputFiles()}) <= 4 < len(log.days())
    assert log.latest("at", 1000, "i").count() == 101


def test_streaks_run_over_the_ends_of_pieces(spark):
    draw = np.random.default_rng(8)
    flags = {"a": draw.random(400) < 0.7, "b": np.ones(150, bool), "c": np.zeros(40, bool), None: draw.random(9) < 0.5}
    flags["a"][100:260] = True  # longer than a piece
    rows = [(n, i, bool(x) if x or i % 3 else None) for n, f in flags.items() for i, x in enumerate(f)]
    want = {}
    for n, f in flags.items():
        runs = [len(r) for r in "".join("x" if x else " " for x in f).split()]
        if runs:
            want[n] = (max(runs), sum(runs) / len(runs))
    df = spark.createDataFrame(rows, "name string, at long, flag boolean")
    for into in (1, 7, 60):
        got = {r["name"]: (r["worst"], r["mean"]) for r in streaks.streaks(df.repartition(3), "name", "flag", ["at"], into).collect()}
        assert got == {n: (w, pytest.approx(m)) for n, (w, m) in want.items()}
    plan = streaks.streaks(df, "name", "flag", ["at"], 7)._jdf.queryExecution().optimizedPlan().toString()
    assert all("_flag" not in line for line in plan.split("\n") if "Window" in line)  # rows themselves are in no window


def test_percentiles_equal_numpy_and_gather_no_values(spark):
    draw = np.random.default_rng(9)
    for values in (draw.normal(size=30_000), draw.integers(0, 3, 5_000).astype(float), np.array([4.0]), np.array([2.0, 1.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
        got = percentiles.percentiles(df, "v", {"low": 0.01, "mid": 0.5, "top": 1.0, "high": 0.99}).first()
        assert tuple(got) == pytest.approx(tuple(np.quantile(values, [0.01, 0.5, 1.0, 0.99])), abs=1e-12)
    assert tuple(percentiles.percentiles(df.where("false"), "v", {"low": 0.01}).first()) == (None,)
    plan = percentiles.percentiles(df, "v", {"low": 0.01})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "percentile_approx" in plan


def test_partitions_of_bars_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(bar_source, "PART_BYTES", 10_000)
    n = bar_source.parts(spark, SMALL)
    assert n > 8
    for df in (bar_source.bars(spark, SMALL), divergence.wd3_pivot_pairs(spark, SMALL), ensemble.e01_consensus(spark, SMALL)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.split("\n") if "hashpartitioning" in line]
        assert exchanges and all(f", {n})" in line for line in exchanges), "\n".join(exchanges)


def _exchanges(df) -> int:
    return sum("Exchange" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


@pytest.mark.parametrize("name", ["p10_duplicate_policies", "p09_cleaned_bars", "a26_findings", "wm12_connors_rsi"])
def test_rows_by_symbol_are_not_shuffled_again(spark, monkeypatch, name):
    """The bars' one shuffle, whose partitions grow with the table, serves planted faults and smoothing, too."""
    monkeypatch.setattr(bar_source, "PART_BYTES", 10_000)
    assert _exchanges(registry.QUERIES[name](spark, SMALL)) == 1


def test_smoothing_shuffles_rows_that_do_not_lie_by_symbol(spark):
    rows = spark.createDataFrame([(s, date(2024, 1, 1) + timedelta(i), float(i)) for i in range(40) for s in range(7)], "symbol long, ts date, close double").repartition(5)
    made = Plan(Source(lambda *_: rows, ""), ({"unused": "close + 1"}, {"e": ("close", 0.5, 0)})).returning("symbol", "ts", "e").frame(spark, "")
    assert _exchanges(made) == 2  # that of the test and one by symbol
    assert "unused" not in made._jdf.queryExecution().optimizedPlan().toString()
    want, value = [], None
    for i in range(40):
        value = float(i) if value is None else value / 2 + i / 2
        want.append(value)
    got = made.orderBy("symbol", "ts").collect()
    assert [r["e"] for r in got] == pytest.approx(want * 7)
