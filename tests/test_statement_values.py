"""Statements of breadth, calibration, drift and performance against pandas, written from their definitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from barloom.plans import registry
from barloom.sources import tables as t
from barloom.sources.bars import BARS

from .conftest import SMALL


@pytest.fixture(scope="module")
def f(spark):
    """Base tables in pandas; everything else is computed from them here."""
    out = {n: s.frame(spark, SMALL).toPandas() for n, s in (("bars", BARS), ("instruments", t.INSTRUMENTS), ("trades", t.TRADES), ("outcomes", t.OUTCOMES), ("statements", t.STATEMENTS), ("events", t.EVENTS))}
    bars = out["bars"].merge(out["instruments"][["symbol", "sector"]], on="symbol").sort_values(["symbol", "ts"]).reset_index(drop=True)
    bars["volume"], by = bars.volume.astype(float), bars.groupby("symbol")
    bars["previous"] = by.close.shift()
    for n in (20, 50):
        bars[f"ma_{n}"], bars[f"m{n}"] = by.close.transform(lambda s, n=n: s.rolling(n).mean()), bars.close / by.close.shift(n) - 1
    bars["high_20"], bars["low_20"] = by.high.transform(lambda s: s.rolling(20, 1).max()), by.low.transform(lambda s: s.rolling(20, 1).min())
    bars["r"] = bars.close / bars.previous - 1
    out["bars"], out["returns"] = bars, bars[bars.previous.notna()]
    trades = out["trades"]
    for c in trades.columns:
        if trades[c].dtype == object and c not in ("strategy", "regime", "ts"):
            trades[c] = trades[c].astype(float)
    trades["net"] = trades.gross_return - trades.cost_rate
    outcomes = out["outcomes"]
    for c in ("score", "net_return"):
        outcomes[c] = outcomes[c].astype(float)
    outcomes["bin"] = np.minimum(np.floor(outcomes.score / 10), 9).astype(int)
    outcomes["side"] = np.where(pd.to_datetime(outcomes.ts) < "1997-01-01", "ref", "cur")
    for c in ("revenue", "profit", "debt"):
        out["statements"][c] = out["statements"][c].astype(float)
    return out


def share(mask) -> float:
    return float(np.mean(mask))


def by(frame, keys, **figures):
    """{key: (figures)} of the groups of a frame."""
    return {k if isinstance(k, tuple) else (k,): tuple(g(x) for g in figures.values()) for k, x in frame.groupby(keys)}


def _bins(o):
    return by(o, ["strategy", "bin"], n=len, score=lambda x: x.score.mean() / 100, rate=lambda x: x.hit.mean())


def _calibration(o):
    rows = {}
    for (s, _), (n, score, rate) in _bins(o).items():
        rows.setdefault(s, []).append((n, abs(score - rate)))
    return {(s,): (sum(n * g for n, g in v) / sum(n for n, _ in v), max(g for _, g in v)) for s, v in rows.items()}


def _ratio(x) -> float:
    up, down = (x.close > x.previous).sum(), (x.close < x.previous).sum()
    return (float(up) if up else 1.0) if not down else up / down


def _shift(o, column):
    means = o.groupby(["strategy", "side"])[column].mean().unstack()
    return means["ref"], means["cur"]


def _curve(r):
    """(longest under water) from the equity of a symbol."""
    equity = np.exp(np.cumsum(np.where(r > -1, np.log1p(np.maximum(r, -0.999999999)), 0.0)))
    under, worst, run = equity < np.maximum.accumulate(equity), 0, 0
    for u in under:
        run = run + 1 if u else 0
        worst = max(worst, run)
    return worst


CASES = {
    "a01_advance_decline": (["ts"], ["advances", "declines", "unchanged", "ratio"], lambda f: by(f["returns"], "ts", a=lambda x: (x.close > x.previous).sum(), d=lambda x: (x.close < x.previous).sum(), u=lambda x: (x.close == x.previous).sum(), r=_ratio)),
    "a03_new_highs_lows": (["ts"], ["highs_20", "lows_20"], lambda f: by(f["bars"], "ts", h=lambda x: (x.high >= x.high_20).sum(), l=lambda x: (x.low <= x.low_20).sum())),
    "a04_volume_breadth": (["ts"], ["up_volume", "down_volume"], lambda f: by(f["bars"], "ts", u=lambda x: x.volume[x.close > x.previous].sum(), d=lambda x: x.volume[x.close < x.previous].sum())),
    "a05_momentum_breadth": (["ts"], ["positive_pct", "thrust_pct"], lambda f: by(f["returns"], "ts", p=lambda x: 100 * share(x.r > 0), t=lambda x: 100 * share(x.r > 0.01))),
    "a07_sector_breadth": (["ts", "sector"], ["advances", "declines", "above_20"], lambda f: {k: v for g in (f["returns"], f["returns"].assign(sector="MARKET")) for k, v in by(g, ["ts", "sector"], a=lambda x: (x.close > x.previous).sum(), d=lambda x: (x.close < x.previous).sum(), m=lambda x: 100 * share(x.close > x.ma_20)).items()}),
    "a12_regime_universe": (["ts"], ["risk_on_pct", "risk_off_pct", "n"], lambda f: by(f["bars"][f["bars"].ma_50.notna()], "ts", on=lambda x: 100 * share((x.close > x.ma_20) & (x.close > x.ma_50)), off=lambda x: 100 * share((x.close < x.ma_20) & (x.close < x.ma_50)), n=len)),
    "a10_relative_strength": (["symbol", "ts"], ["score"], lambda f: {(s, ts): (min(100, max(0, 50 + 100 * (a + b))),) for s, ts, a, b in f["bars"].dropna(subset=["m20", "m50"])[["symbol", "ts", "m20", "m50"]].itertuples(index=False)}),
    "a11_sector_rotation": (["ts", "sector"], ["rs"], lambda f: by(f["bars"].dropna(subset=["m20"]), ["ts", "sector"], m=lambda x: x.m20.mean())),
    "a14_factor_concentration": (["sector", "ts"], ["concentration"], lambda f: by(f["bars"], ["sector", "ts"], h=lambda x: ((x.volume / x.volume.sum()) ** 2).sum())),
    "a19_ratios": (["symbol", "period"], ["margin", "debt_to_revenue"], lambda f: {(s, p): (b / a, d / a) for s, p, a, b, d in f["statements"][["symbol", "period", "revenue", "profit", "debt"]].itertuples(index=False)}),
    "a22_statement_pivot": (["symbol", "fiscal_year"], ["q1", "q4"], lambda f: by(f["statements"], ["symbol", "fiscal_year"], a=lambda x: x.revenue[x.fiscal_quarter == 1].sum() or None, d=lambda x: x.revenue[x.fiscal_quarter == 4].sum() or None)),
    "a23_event_risk": (["user_id", "day"], ["risk"], lambda f: by(f["events"].assign(day=pd.to_datetime(f["events"].ts).dt.date, p=f["events"].event_type.map({"error": 50, "purchase": 30, "click": 15}).fillna(5)), ["user_id", "day"], r=lambda x: min(100, x.p.sum()))),
    "a30_outcome_summary": (["strategy", "state"], ["n", "mean_return", "hit_rate"], lambda f: by(f["outcomes"], ["strategy", "state"], n=len, m=lambda x: x.net_return.mean(), h=lambda x: x.hit.mean())),
    "a31_repeated_patterns": (["user_id", "event_type"], ["n", "first_case"], lambda f: {k: v for k, v in by(f["events"], ["user_id", "event_type"], n=len, m=lambda x: x.event_id.min()).items() if v[0] >= 3}),
    "t03_min_max": (["symbol", "ts"], ["scaled"], lambda f: {(s, d): (50.0 if hi == lo else 100 * (c - lo) / (hi - lo),) for s, d, c, lo, hi in f["bars"].assign(lo=f["bars"].groupby("ts").close.transform("min"), hi=f["bars"].groupby("ts").close.transform("max"))[["symbol", "ts", "close", "lo", "hi"]].itertuples(index=False)}),
    "c02_score_bins": (["strategy", "bin"], ["n", "mean_score", "rate"], lambda f: _bins(f["outcomes"])),
    "c04_calibration_metrics": (["strategy"], ["ece", "mce"], lambda f: _calibration(f["outcomes"])),
    "c04_brier_and_rates": (["strategy"], ["brier", "precision_50", "recall_50", "fpr_50"], lambda f: by(f["outcomes"], "strategy", b=lambda x: ((x.score / 100 - x.hit) ** 2).mean(), p=lambda x: x.hit[x.score >= 50].mean(), r=lambda x: (x.score[x.hit == 1] >= 50).mean(), q=lambda x: (x.score[x.hit == 0] >= 50).mean())),
    "c06_threshold_sweep": (["strategy", "cut"], ["n", "hit_rate", "quality"], lambda f: {(s, c): (len(y), y.hit.mean(), y.hit.mean() * y.net_return.mean() * len(y) ** 0.5) for s, x in f["outcomes"].groupby("strategy") for c in range(30, 95, 5) for y in [x[x.score >= c]] if len(y)}),
    "c08_cohorts": (["field", "value"], ["n", "rate", "gap"], lambda f: {(k, *v): w for k in ("strategy", "cohort") for v, w in by(f["outcomes"], k, n=len, r=lambda x: x.hit.mean(), g=lambda x: (x.hit - x.score / 100).mean()).items()}),
    "d05_categorical_drift": (["cohort"], ["p", "q"], lambda f: {(c,): (share(f["outcomes"].cohort[f["outcomes"].side == "ref"] == c), share(f["outcomes"].cohort[f["outcomes"].side == "cur"] == c)) for c in f["outcomes"].cohort.unique()}),
    "d08_signal_decay": (["strategy"], ["ref_hit", "cur_hit"], lambda f: {(s,): (a, b) for (s, a), b in zip(_shift(f["outcomes"], "hit")[0].items(), _shift(f["outcomes"], "hit")[1], strict=True)}),
    "d09_strategy_decay": (["strategy"], ["decay_score"], lambda f: {(s,): (min(100, max(0, 100 * (a - b) / abs(a))),) for (s, a), b in zip(_shift(f["outcomes"], "net_return")[0].items(), _shift(f["outcomes"], "net_return")[1], strict=True)}),
    "e08_adaptive_scores": (["strategy", "cohort"], ["adaptive", "confidence"], lambda f: by(f["outcomes"], ["strategy", "cohort"], a=lambda x: 50 + np.clip(x.net_return.mean() * 5, -50, 50), c=lambda x: min(1, len(x) / 100))),
    "e10_scorecard": (["strategy"], ["score"], lambda f: by(f["outcomes"], "strategy", s=lambda x: 40 * x.hit.mean() + 0.4 * np.clip(50 + 5 * x.net_return.mean(), 0, 100) + 0.2 * min(100, len(x) / 10))),
    "b01_return_metrics": (["symbol"], ["n", "volatility", "sharpe"], lambda f: by(f["returns"], "symbol", n=len, v=lambda x: x.r.std() * 252**0.5, s=lambda x: x.r.mean() / x.r.std() * 252**0.5)),
    "b02_var_cvar": (["symbol"], ["var_95", "cvar_95"], lambda f: by(f["returns"], "symbol", v=lambda x: x.r.quantile(0.05), c=lambda x: x.r[x.r <= x.r.quantile(0.05)].mean())),
    "b03_trade_metrics": (["strategy"], ["n", "win_rate", "mean_net", "profit_factor", "holding"], lambda f: by(f["trades"], "strategy", n=len, w=lambda x: share(x.net > 0), m=lambda x: x.net.mean(), p=lambda x: x.net[x.net > 0].sum() / -x.net[x.net < 0].sum(), h=lambda x: x.bars_held.mean())),
    "b04_performance_by_regime": (["strategy", "regime"], ["mean_net"], lambda f: by(f["trades"], ["strategy", "regime"], m=lambda x: x.net.mean())),
    "b06_monitoring_metrics": (["symbol"], ["win_rate", "sharpe_like"], lambda f: by(f["trades"], "symbol", w=lambda x: share(x.net > 0), s=lambda x: x.net.mean() / x.net.std(ddof=0))),
    "b09_fill_quality": (["symbol", "strategy"], ["fill_rate", "cost_bps"], lambda f: by(f["trades"], ["symbol", "strategy"], q=lambda x: x.quantity.mean() / 50, c=lambda x: x.cost_rate.mean() * 10_000)),
    "b23_return_summary": (["symbol"], ["n", "mean_r", "sd", "low", "high"], lambda f: by(f["returns"], "symbol", n=len, m=lambda x: x.r.mean(), s=lambda x: x.r.std(ddof=0), l=lambda x: x.r.min(), h=lambda x: x.r.max())),
    "b24_loss_buffer": (["symbol"], ["buffer"], lambda f: by(f["returns"], "symbol", b=lambda x: max(0, 1.645 * x.r.std() * 21**0.5 - 21 * x.r.mean()))),
    "b26_tail_probabilities": (["symbol"], ["p_loss", "p_deep", "midrank"], lambda f: by(f["returns"], "symbol", a=lambda x: share(x.r < 0), b=lambda x: share(x.r < -0.2), c=lambda x: share(x.r < 0.01) + 0.5 * share(x.r == 0.01))),
    "b29_objective_grid": (["target", "hold", "strategy"], ["objective"], lambda f: {(g, h, s): (x.net.where((x.bars_held <= h) & (x.gross_return >= g), 0).mean(),) for g in (0.0, 0.02) for h in (5, 10) for s, x in f["trades"].groupby("strategy")}),
    "we2_longest_underwater": (["symbol"], ["longest"], lambda f: {k: v for k, v in by(f["returns"], "symbol", u=lambda x: _curve(x.r.to_numpy())).items() if v[0]}),
}


@pytest.mark.parametrize("name", CASES)
def test_statement_follows_its_definition(spark, f, name):
    keys, columns, compute = CASES[name]
    plain = lambda v: round(float(v), 6) if isinstance(v, (int, float, np.number)) or type(v).__name__ == "Decimal" else str(v)
    got = {tuple(plain(r[k]) for k in keys): [float("nan") if r[c] is None else float(r[c]) for c in columns] for r in registry.QUERIES[name](spark, SMALL).select(*keys, *columns).collect()}
    want = {tuple(map(plain, k)): [float("nan") if v is None else float(v) for v in row] for k, row in compute(f).items()}
    assert got.keys() == want.keys()
    for k, row in want.items():
        assert got[k] == pytest.approx(row, rel=1e-4, abs=2e-4, nan_ok=True), k
