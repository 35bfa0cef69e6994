"""Price patterns, pivots, drawdowns, labels and regimes over bars: layers and outputs as in indicators.py.

No window looks ahead but those of the labels. An unfilled window gives a flag of 0.0 and a null distance.
"""

from __future__ import annotations

from barloom.operators.indicators import RETURN, YEAR, lag, over_zero, roll, running
from barloom.plans.layers import clip, flag, lead, sign


def before(aggregate: str, column: str, n: int) -> str:
    """Over the n bars before this one, all present."""
    return roll(aggregate, column, n, end=1)


_HL20 = {"ph": before("max", "high", 20), "pl": before("min", "low", 20)}
_HL50 = {"ph": before("max", "high", 50), "pl": before("min", "low", 50)}
_WICKS = {"body": "abs(close - open)", "span": "high - low", "upper_wick": "high - greatest(open, close)", "lower_wick": "least(open, close) - low", "po": lag("open"), "pc": lag("close")}
_HAMMER = "body / nullif(span, 0) <= 0.35 AND {a} >= body * 2.0 AND {b} / nullif(span, 0) <= 0.25"
_CANDLES = {
    "bullish_engulfing": flag("pc < po AND close > open AND close > po AND open < pc"), "bearish_engulfing": flag("pc > po AND close < open AND close < po AND open > pc"),
    "candle_hammer": flag(_HAMMER.format(a="lower_wick", b="upper_wick")), "candle_inverted_hammer": flag(_HAMMER.format(a="upper_wick", b="lower_wick")),
    "bullish_marubozu": flag("close > open AND (upper_wick + lower_wick) / nullif(span, 0) <= 0.1"), "bearish_marubozu": flag("close < open AND (upper_wick + lower_wick) / nullif(span, 0) <= 0.1"),
}
_VOLUME_BREAK = {"up": flag("close > ph"), "down": flag("close < pl"), "vup": flag("close > ph AND volume > 1.5 * base"), "vdown": flag("close < pl AND volume > 1.5 * base"), "gup": flag("gap > 0.02"), "gdown": flag("gap < -0.02")}

PATTERNS = {
    "wp01_rolling_high_low": ([_HL20, {"rolling_higher_high_20": flag("high > ph"), "rolling_lower_low_20": flag("low < pl")}], ["rolling_higher_high_20", "rolling_lower_low_20"]),
    "wp02_swing_points": ([{"ph": before("max", "high", 5), "pl": before("min", "low", 5)}, {"swing_high_lb_5": flag("high > ph"), "swing_low_lb_5": flag("low < pl")}], ["swing_high_lb_5", "swing_low_lb_5"]),
    "wp03_market_structure_state": (
        [_HL20, {"bull": "coalesce(high > ph OR low > pl, FALSE)", "bear": "coalesce(high < ph OR low < pl, FALSE)"},
         {"structure_state_20": "CASE WHEN bull AND NOT bear THEN CAST(1 AS DOUBLE) WHEN bear AND NOT bull THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"}],
        ["structure_state_20"]),
    "wp04_range_position": ([{"hh": roll("max", "high", 20), "ll": roll("min", "low", 20)}, {"range_position_20": over_zero("close - ll", "(hh - ll)")}], ["range_position_20"]),
    "wp05_range_compression": ([{"hl": "high - low"}, {"range_compression_10_50": over_zero(roll("avg", "hl", 10), roll("avg", "hl", 50))}], ["range_compression_10_50"]),
    "wp06_price_breakout": (
        [_HL20, {"price_breakout_up_20": flag("close > ph"), "price_breakout_down_20": flag("close < pl"), "price_breakout_distance_up_20": over_zero("close - ph", "ph"), "price_breakout_distance_down_20": over_zero("pl - close", "pl")}],
        ["price_breakout_up_20", "price_breakout_down_20", "price_breakout_distance_up_20", "price_breakout_distance_down_20"]),
    "wp07_volume_confirmed_breakout": (
        [_HL20 | {"base": before("avg", "volume", 20)},
         {"volume_confirmed_breakout_up_20_20": flag("close > ph AND volume > 1.5 * base"), "volume_confirmed_breakout_down_20_20": flag("close < pl AND volume > 1.5 * base"), "breakout_volume_ratio_20": over_zero("volume", "base")}],
        ["volume_confirmed_breakout_up_20_20", "volume_confirmed_breakout_down_20_20", "breakout_volume_ratio_20"]),
    "wp08_false_breakout": (
        [{"ph": roll("max", "high", 20, end=4), "pl": roll("min", "low", 20, end=4), "c3": lag("close", 3)}, {"false_breakout_up_lagged_20_3": flag("c3 > ph AND close < ph"), "false_breakout_down_lagged_20_3": flag("c3 < pl AND close > pl")}],
        ["false_breakout_up_lagged_20_3", "false_breakout_down_lagged_20_3"]),
    "wp09_breakout_retest": (
        [_HL20, {"breakout_retest_up_20": flag("low <= ph * 1.01 AND low >= ph * 0.99 AND close > ph * 0.99"), "breakout_retest_down_20": flag("high >= pl * 0.99 AND high <= pl * 1.01 AND close < pl * 1.01")}],
        ["breakout_retest_up_20", "breakout_retest_down_20"]),
    "wp10_gap_breakout": ([{"gap": f"open / nullif({lag('close')}, 0) - 1"}, {"gap_up_2pct": flag("gap > 0.02"), "gap_down_2pct": flag("gap < -0.02")}], ["gap_up_2pct", "gap_down_2pct"]),
    "wp11_breakout_composite": (
        [_HL20 | {"base": before("avg", "volume", 20), "gap": f"open / nullif({lag('close')}, 0) - 1"}, _VOLUME_BREAK,
         {"breakout_pressure_score": clip("20 * (up + down) + 40 * (vup + vdown) + 20 * (gup + gdown)", 0, 100), "breakout_direction_score": clip("20 * (up - down) + 30 * (vup - vdown) + 20 * (gup - gdown)", -100, 100)}],
        ["breakout_pressure_score", "breakout_direction_score"]),
    "wp12_candle_body_metrics": (
        [_WICKS, {"candle_body_pct": over_zero("body", "span"), "candle_upper_wick_pct": over_zero("upper_wick", "span"), "candle_lower_wick_pct": over_zero("lower_wick", "span"), "candle_range_pct": over_zero("span", "pc"), "candle_direction": sign("close", "open")}],
        ["candle_body_pct", "candle_upper_wick_pct", "candle_lower_wick_pct", "candle_range_pct", "candle_direction"]),
    "wp13_doji": ([_WICKS, {"candle_doji": flag("body <= span * 0.1 AND span > 0")}], ["candle_doji"]),
    "wp14_hammer": ([_WICKS, _CANDLES], ["candle_hammer", "candle_inverted_hammer"]),
    "wp15_engulfing": ([_WICKS, _CANDLES], ["bullish_engulfing", "bearish_engulfing"]),
    "wp16_inside_outside_bar": ([{"h1": lag("high"), "l1": lag("low")}, {"inside_bar": flag("high < h1 AND low > l1"), "outside_bar": flag("high > h1 AND low < l1")}], ["inside_bar", "outside_bar"]),
    "wp17_marubozu": ([_WICKS, _CANDLES], ["bullish_marubozu", "bearish_marubozu"]),
    "wp18_candle_composite": (
        [_WICKS, _CANDLES, {"candle_pattern_score": clip("40 * (bullish_engulfing - bearish_engulfing) + 30 * (candle_hammer - candle_inverted_hammer) + 30 * (bullish_marubozu - bearish_marubozu)", -100, 100)}], ["candle_pattern_score"]),
    "wp19_rolling_sr": (
        [_HL50, {"distance_to_resistance_50": over_zero("ph - close", "close"), "distance_to_support_50": over_zero("close - pl", "close")}],
        ["ph AS rolling_resistance_50", "pl AS rolling_support_50", "distance_to_resistance_50", "distance_to_support_50"]),
    "wp20_pivot_points": (
        [{"h1": lag("high"), "l1": lag("low"), "c1": lag("close")}, {"pivot_point": "(h1 + l1 + c1) / 3"}, {"pivot_r1": "2 * pivot_point - l1", "pivot_s1": "2 * pivot_point - h1", "pivot_r2": "pivot_point + (h1 - l1)", "pivot_s2": "pivot_point - (h1 - l1)"}],
        ["pivot_point", "pivot_r1", "pivot_s1", "pivot_r2", "pivot_s2"]),
    "wp21_sr_touch_count": (
        [_HL50 | {"hs": "gather(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)", "ls": "gather(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)"},
         {"resistance_touch_count_50": "CASE WHEN ph IS NOT NULL THEN length_of(kept_in(hs, v -> v >= ph * 0.99)) END", "support_touch_count_50": "CASE WHEN pl IS NOT NULL THEN length_of(kept_in(ls, v -> v <= pl * 1.01)) END"}],
        ["resistance_touch_count_50", "support_touch_count_50"]),
    "wp22_near_sr": ([_HL50, {"near_resistance_50": flag("close >= ph * 0.98"), "near_support_50": flag("close <= pl * 1.02")}], ["near_resistance_50", "near_support_50"]),
    "wp23_sr_composite": (
        [_HL50, {"sr_position_score": clip("(close - pl) / nullif(ph - pl, 0) * 100", 0, 100), "sr_pressure_score": f"50 * ({flag('close <= pl * 1.02')}) - 50 * ({flag('close >= ph * 0.98')})"}],
        ["sr_position_score", "sr_pressure_score"]),
}


def _pivot(column: str, aggregate: str, sign_: str, lookback: int = 5, confirm: int = 2) -> str:
    """The value `confirm` bars ago is the extremum of its window, strictly over the bars since."""
    at = lag(column, confirm)
    return f"coalesce({at} = {roll(aggregate, column, lookback + confirm + 1)} AND {at} {sign_} {roll(aggregate, column, confirm)}, FALSE)"


_PIVOTS = [
    {"pos": "row_number() OVER (PARTITION BY symbol ORDER BY ts)", "momentum": f"close - {lag('close', 10)}"},
    {"pivot_high": _pivot("close", "max", ">"), "pivot_low": _pivot("close", "min", "<"), "high_lookback": f"coalesce(close > {before('max', 'close', 5)}, FALSE)", "low_lookback": f"coalesce(close < {before('min', 'close', 5)}, FALSE)"},
]
_EQUITY = [{"r": RETURN}, {"growth": "CASE WHEN r > -1 THEN ln(1 + r) ELSE 0 END"}, {"equity": f"exp({running('sum(growth)')})"}, {"peak": running("max(equity)")}, {"drawdown": "equity - peak", "drawdown_pct": over_zero("equity - peak", "peak")}]
_REGIME = [
    {"m": roll("avg", "close", 20), "r": RETURN, "av": roll("avg", "volume", 20), "roc": f"close / nullif({lag('close', 10)}, 0) - 1", "hh": roll("max", "high", 20), "ll": roll("min", "low", 20)},
    {"hv": f"{roll('stddev_samp', 'r', 20)} * sqrt({YEAR})"},
    {"trend": clip("50.0 + (close - m) / nullif(m, 0) * 250.0", 0, 100), "vol": clip("(hv - 0.10) / 0.50 * 100.0", 0, 100), "liq": "coalesce(" + clip("(volume / nullif(av, 0) - 0.5) / 1.5 * 100.0", 0, 100) + ", 50.0)",
     "mom": clip("50.0 + roc * 250.0", 0, 100), "rng": "coalesce(" + clip("(close - ll) / nullif(hh - ll, 0) * 100.0", 0, 100) + ", 50.0)"},
    {"composite": clip("trend * 0.4 + (100.0 - vol) * 0.2 + liq * 0.2 + mom * 0.2", 0, 100)},
]
_REGIME_OUT = [f"coalesce({c}, 50.0) AS regime_{n}_score" for c, n in (("trend", "trend"), ("vol", "volatility"), ("liq", "liquidity"), ("mom", "momentum"), ("rng", "range"), ("composite", "composite"))]
_TREND_CLASS = "CASE WHEN trend >= 60 THEN 'UP' WHEN trend <= 40 THEN 'DOWN' ELSE 'SIDEWAYS' END"
_VOL_CLASS = "CASE WHEN vol >= 70 THEN 'HIGH' WHEN vol <= 30 THEN 'LOW' ELSE 'NORMAL' END"

WINDOWED = {
    "wd1_pivot_flags": ([*_PIVOTS], ["pivot_high", "pivot_low", "high_lookback", "low_lookback"]),
    "wd2_pivot_points": (
        [*_PIVOTS, {"actual_ts": lag("ts", 2), "actual_value": lag("close", 2)}, "where pivot_high OR pivot_low"], ["CASE WHEN pivot_high THEN 'HIGH' ELSE 'LOW' END AS kind", "actual_ts", "pos - 2 AS actual_pos", "actual_value"]),
    "wd5_bars_since_pivot": (
        [*_PIVOTS, {"mark": "CASE WHEN pivot_high THEN pos END"}, {"last_mark": running("max(mark)")}], ["pos - last_mark AS bars_since_pivot_high"]),
    "we1_drawdown_curve": (_EQUITY, ["ln(equity) AS log_equity", "drawdown_pct"]),
    "we4_equity_curve": (_EQUITY[:3], ["ln(equity) AS log_equity"]),
    "we5_return_features": (
        [{"ret_1": RETURN, "ret_5": f"close / nullif({lag('close', 5)}, 0) - 1", "ret_20": f"close / nullif({lag('close', 20)}, 0) - 1", "close_open": over_zero("close - open", "open"), "intraday_range": over_zero("high - low", "close")}],
        ["ret_1", "ret_5", "ret_20", "close_open", "intraday_range"]),
    "wl1_forward_return": ([{"forward_return_5": f"{lead('close', 5)} / nullif(close, 0) - 1"}], ["forward_return_5"]),
    "wl2_direction_labels": (
        [{"fwd": f"{lead('close', 5)} / nullif(close, 0) - 1", "r": RETURN}, {"sd": roll("stddev_samp", "r", 20)},
         {"binary_label": "CASE WHEN fwd > 0 THEN 1 WHEN fwd IS NOT NULL THEN 0 END", "three_class_label": "CASE WHEN fwd > 0.02 THEN 1 WHEN fwd < -0.02 THEN -1 WHEN fwd IS NOT NULL THEN 0 END",
          "event_label": "CASE WHEN abs(fwd) > 0.05 THEN 1 WHEN fwd IS NOT NULL THEN 0 END", "vol_adjusted_return": over_zero("fwd", "sd")}],
        ["binary_label", "three_class_label", "event_label", "vol_adjusted_return"]),
    "wf1_feature_primitives": ([{"pct": RETURN}, {"rolling_std": roll("stddev_samp", "close", 20), "z": over_zero(f"close - {roll('avg', 'close', 20)}", roll("stddev_samp", "close", 20))}], ["pct", "rolling_std", "z"]),
    "wr1_regime_columns": (_REGIME, _REGIME_OUT),
    "wr2_latest_regime": ([*_REGIME, {"slope": f"(m - {lag('m', 4)}) / nullif(m, 0)", "newest": "row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)"}, "where newest = 1"], [*_REGIME_OUT, "slope"]),
    "wr3_regime_classes": (
        [*_REGIME, {"trend_class": _TREND_CLASS, "volatility_class": _VOL_CLASS},
         {"market_regime": "CASE WHEN volatility_class = 'HIGH' AND trend_class = 'DOWN' THEN 'STRESS' WHEN trend_class = 'UP' AND volatility_class <> 'HIGH' THEN 'RISK_ON' WHEN trend_class = 'DOWN' THEN 'RISK_OFF' ELSE 'RANGE' END",
          "confidence": clip("abs(composite - 50) * 2", 0, 100)}],
        ["trend_class", "volatility_class", "market_regime", "confidence"]),
    "ws1_stops_and_targets": (
        [{"tr": "high - low", "r": RETURN}, {"atr": roll("avg", "tr", 14), "swing": roll("min", "low", 10), "sd": roll("stddev_samp", "r", 20)}, {"fixed_stop": "close * 0.95"},
         {"atr_stop": "CASE WHEN atr IS NOT NULL AND close - 2 * atr > 0 THEN close - 2 * atr ELSE fixed_stop END", "swing_stop": "CASE WHEN swing < close THEN swing ELSE fixed_stop END", "vol_stop": "CASE WHEN sd IS NOT NULL AND sd < 0.5 THEN close * (1 - 2 * sd) ELSE fixed_stop END"}],
        ["fixed_stop", "atr_stop", "swing_stop", "vol_stop", "close + 2 * (close - atr_stop) AS target_2r"]),
    "g01_moving_average_trend": (
        [{"f": roll("avg", "close", 20), "s": roll("avg", "close", 50)}, {"is_long": "coalesce(close > f AND f > s, FALSE)"}, {"score": "CASE WHEN is_long THEN 70 ELSE 20 END"}, {"direction": "CASE WHEN is_long AND score >= 60 THEN 'LONG' ELSE 'FLAT' END"}], ["score", "direction"]),
    "g02_rsi_mean_reversion": (
        [{"d": f"close - {lag('close')}"}, {"gain": "greatest(d, 0 * d)", "loss": "greatest(-d, 0 * d)"}, {"ag": roll("avg", "gain", 14), "al": roll("avg", "loss", 14)}, {"rsi": "CASE WHEN al = 0 THEN CAST(100 AS DOUBLE) ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END"},
         {"score": "CASE WHEN rsi < 30 THEN least(100, 65 + (30 - rsi)) ELSE 20 END", "direction": "CASE WHEN rsi < 30 THEN 'LONG' WHEN rsi > 70 THEN 'EXIT' ELSE 'FLAT' END"}],
        ["rsi", "score", "direction"]),
    "g03_breakout_with_volume": (
        [_HL20 | {"base": before("avg", "volume", 20)}, {"score": "CASE WHEN close > ph AND volume > 1.5 * base THEN 80 WHEN close > ph THEN 45 ELSE 20 END"}, {"direction": "CASE WHEN score = 80 THEN 'LONG' WHEN score = 45 THEN 'WATCH' ELSE 'FLAT' END"}], ["score", "direction"]),
    "g04_composite_signal": ([*_REGIME, {"score": "(coalesce(trend, 50) + coalesce(mom, 50) + coalesce(liq, 50)) / 3"}], ["score", "CASE WHEN score >= 60 THEN 'LONG' ELSE 'FLAT' END AS direction"]),
    "g05_score_helpers": (
        [*_REGIME, {"s": "coalesce(composite, 50)"}, {"strength": "CASE WHEN s < 20 THEN 'VERY_WEAK' WHEN s < 40 THEN 'WEAK' WHEN s < 60 THEN 'NEUTRAL' WHEN s < 80 THEN 'STRONG' ELSE 'VERY_STRONG' END", "risk_reward": over_zero("high - close", "(close - low)")}], ["s AS score", "strength", "risk_reward"]),
    "g06_baseline_positions": (
        [{"m": roll("avg", "close", 20), "roc": f"close / nullif({lag('close', 20)}, 0) - 1", "r": RETURN}, {"sd": roll("stddev_samp", "r", 20)},
         {"buy_hold": "1", "cash": "0", "ma_position": "CASE WHEN close > m THEN 1 ELSE 0 END", "momentum_position": "CASE WHEN roc > 0 THEN 1 ELSE 0 END", "vol_filter_position": "CASE WHEN sd < 0.1 THEN 1 ELSE 0 END"}],
        ["buy_hold", "cash", "ma_position", "momentum_position", "vol_filter_position"]),
    "g07_signal_backtest": (
        [{"f": roll("avg", "close", 20), "s": roll("avg", "close", 50)}, {"want": "CASE WHEN close > f AND f > s THEN 1 ELSE 0 END"}, {"held": f"coalesce({lag('want')}, 0)", "r": RETURN}, {"turn": f"abs(held - coalesce({lag('held')}, 0))"},
         {"net": "held * coalesce(r, 0) - turn * 0.001"}, {"growth": "CASE WHEN net > -1 THEN ln(1 + net) ELSE 0 END"}, {"log_equity": running("sum(growth)")}],
        ["held", "turn", "net", "log_equity"]),
    "g08_position_size": (
        [{"tr": "high - low", "r": RETURN}, {"atr": roll("avg", "tr", 14), "sd": roll("stddev_samp", "r", 20)},
         {"fixed_size": "CAST(floor(10000 / nullif(close, 0)) AS BIGINT)", "risk_size": "CAST(floor(1000 / nullif(2 * atr, 0)) AS BIGINT)", "vol_size": "CAST(floor(least(10000 * 0.02 / nullif(sd, 0), 20000) / nullif(close, 0)) AS BIGINT)"}],
        ["fixed_size", "risk_size", "vol_size", "least(risk_size * close, 20000) AS capped_notional"]),
    "g09_risk_decision": (
        [{"tr": "high - low", "t": "close * volume"}, {"atr": roll("avg", "tr", 14), "turnover": roll("avg", "t", 20)}, {"stop": "close - 2 * atr", "target": "close + 3 * atr"}, {"rr": over_zero("target - close", "(close - stop)")},
         {"decision": "CASE WHEN atr IS NULL THEN 'NO_DATA' WHEN stop <= 0 THEN 'REJECT_STOP' WHEN turnover < 10000 THEN 'REJECT_LIQUIDITY' WHEN atr / nullif(close, 0) > 0.5 THEN 'REJECT_VOLATILITY' WHEN rr < 1.2 THEN 'REJECT_REWARD' ELSE 'ACCEPT' END"}],
        ["stop", "target", "rr", "decision"]),
    "p14_outliers": (
        [{"r": RETURN, "vm": "avg(volume) OVER (PARTITION BY symbol)", "vs": "stddev_samp(volume) OVER (PARTITION BY symbol)"}, {"volume_z": over_zero("volume - vm", "vs")}], ["coalesce(abs(r) > 0.35, FALSE) AS extreme_return", "coalesce(abs(volume_z) > 10, FALSE) AS extreme_volume", "volume_z"]),
    "p16_unadjusted_events": ([{"r": RETURN}, "where abs(r) > 0.20"], ["r"]),
    "b08_liquidity_snapshot": (
        [{"t": "close * volume"}, {"avg_volume": roll("avg", "volume", 20), "avg_turnover": roll("avg", "t", 20), "newest": "row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)"}, "where newest = 1"],
        ["avg_volume", "avg_turnover", "avg_turnover * 0.05 AS max_notional", "CASE WHEN avg_turnover >= 100000 THEN 'HIGH' WHEN avg_turnover >= 10000 THEN 'MEDIUM' ELSE 'LOW' END AS liquidity_class"]),
    "m02_leakage_time_order": ([{"previous_ts": lag("ts"), "fwd": lead("close", 1)}], ["previous_ts", "CASE WHEN ts <= previous_ts THEN 1 ELSE 0 END AS out_of_order"]),
    "m04_chronological_split": ([{"place": "row_number() OVER (PARTITION BY symbol ORDER BY ts)", "n": "count(*) OVER (PARTITION BY symbol)"}], ["CASE WHEN place <= n * 0.7 THEN 'train' WHEN place <= n * 0.85 THEN 'validation' ELSE 'test' END AS part"]),
    "p13_fill_and_interpolate": (
        [{"holed": "CASE WHEN volume >= 60 THEN close END", "k": "row_number() OVER (PARTITION BY symbol ORDER BY ts)"}, {"seen": "CASE WHEN holed IS NOT NULL THEN k END"},
         {"pk": running("max(seen)"), "nk": "min(seen) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"},
         {"pv": "max(CASE WHEN k = pk THEN holed END) OVER (PARTITION BY symbol, pk)", "nv": "max(CASE WHEN k = nk THEN holed END) OVER (PARTITION BY symbol, nk)"}],
        ["pv AS ffill", "nv AS bfill", "CASE WHEN nk = pk THEN holed WHEN pk IS NOT NULL AND nk IS NOT NULL THEN pv + (nv - pv) * (k - pk) / (nk - pk) END AS linear"]),
    "r05_calendar_gaps": ([{"previous_ts": lag("ts"), "next_ts": lead("ts")}], ["previous_ts", "next_ts"]),
}
