"""Named queries over the given tables and the SQL they are checked against."""

from __future__ import annotations

from barloom.functions import families
from barloom.functions import indicators as requests
from barloom.operators import alignment, bar_quality, calibration, chunking, cleaning, constraints, correlation, crosssection, divergence, ensemble, evidence, folds, hybrid, learning, percentiles, performance, policies, streaks, resampling, search, tabular, trades, trading_days, valuation
from barloom.operators.indicators import INDICATORS
from barloom.operators.retrieval import QUERIES as JOBS
from barloom.operators.patterns import PATTERNS, WINDOWED
from barloom.operators.smoothed import SMOOTHED
from barloom.plans.layers import Plan
from barloom.sources import store
from barloom.sources.bars import BARS
from barloom.streaming import queries as streaming

#: Decimals of floating columns: enough for any use, few enough that the noise of sums does not show.
DIGITS, LARGE_DIGITS = 9, 6
LARGE = {"adl", "pvt", "force_index", "force_index_ema", "chaikin_osc", "kvo", "kvo_signal", "kvo_hist", "turnover_try", "turnover_try_sma", "eom_millions", "eom_sma_millions", "liquidity_turnover_sma", "avg_turnover", "max_notional"}
#: Columns that are not floating.
EXACT = {
    "bars_above_sma_20", "bars_below_sma_20", "ichimoku_cloud_state", "stoch_cross_event", "vol_regime_state", "rsi_zone", "rsi_above_50", "resistance_touch_count_50", "support_touch_count_50", "pivot_high", "pivot_low",
    "high_lookback", "low_lookback", "kind", "actual_ts", "actual_pos", "bars_since_pivot_high", "binary_label", "three_class_label", "event_label", "trend_class", "volatility_class", "market_regime", "direction", "strength",
    "buy_hold", "cash", "ma_position", "momentum_position", "vol_filter_position", "held", "turn", "fixed_size", "risk_size", "vol_size", "decision", "extreme_return", "extreme_volume", "liquidity_class", "previous_ts", "next_ts", "out_of_order", "part",
}

PLANS: dict[str, Plan] = {}
for _name, (_layers, _out) in (INDICATORS | SMOOTHED | PATTERNS | WINDOWED).items():
    _columns = [c.rsplit(" AS ", 1)[-1] for c in _out]
    _digits = {c: LARGE_DIGITS if c in LARGE else DIGITS for c in _columns if c not in EXACT}
    PLANS[_name] = Plan(BARS, tuple(_layers)).returning("symbol", "ts", *_out, **_digits)
PLANS |= crosssection.STATEMENTS | performance.STATEMENTS | calibration.STATEMENTS | tabular.STATEMENTS
PLANS |= alignment.STATEMENTS | evidence.STATEMENTS | cleaning.STATEMENTS

#: Modules with queries and statements of their own.
MODULES = (learning, hybrid, bar_quality, percentiles, streaks, chunking, correlation, constraints, divergence, ensemble, folds, policies, resampling, search, store, trades, trading_days, valuation, streaming, requests, families)
QUERIES: dict = {n: p.frame for n, p in PLANS.items()} | {n: q for n, (q, _) in JOBS.items()}
ORACLES: dict = {n: p.sql() for n, p in PLANS.items()} | {n: o for n, (_, o) in JOBS.items() if o}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
