"""Windowed indicators over bars(symbol, ts, open, high, low, close, volume).

Every indicator is a list of layers and the columns it returns. Windows are `rows`: the last n bars of a symbol. What an
indicator leaves null follows its definition: a full window unless stated; ratios are null on a zero denominator.
Recursive smoothing is in recursive.py.
"""

from __future__ import annotations

from barloom.plans.layers import clip, flag, lag, over_zero, roll, running, sign

TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
RETURN = f"(close / nullif({lag('close')}, 0) - 1)"
LOG_RETURN = f"CASE WHEN close > 0 AND {lag('close')} > 0 THEN ln(close / {lag('close')}) END"
TYPICAL = "((high + low + close) / 3)"
MONEY_MULTIPLIER = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0)"
YEAR = 252


def share_at_most(column: str, n: int) -> str:
    """Per cent of the last n values at most the current one; null unless all n are present."""
    own = f"gather({column}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {own} END"


def rank_layers(name: str, column: str, n: int) -> tuple[dict, dict]:
    """Two layers: the window's values, then the share. Costs rows times n comparisons, all in the JVM."""
    return {f"{name}_window": share_at_most(column, n)}, {name: f"CASE WHEN {column} IS NOT NULL THEN 100.0 * length_of(kept_in({name}_window, v -> v <= {column})) / length_of({name}_window) END"}


def zscore(column: str, n: int) -> str:
    return over_zero(f"{column} - {roll('avg', column, n)}", roll("stddev_samp", column, n))


def sma(n: int) -> str:
    return roll("avg", "close", n, full=False)


# name: (layers, outputs)
NATIVE = {
    "wn01_sma": ([{"sma": sma(20)}], ["sma"]),
    "wn03_wma": (
        [{"place": "row_number() OVER (PARTITION BY symbol ORDER BY ts)"},
         {"weighted": "place * close"},
         {"upto": roll("sum", "weighted", 20, full=False), "plain": roll("sum", "close", 20, full=False), "n": "least(place, 20)"},
         {"wma": "(upto - (place - n) * plain) / (n * (n + 1) / 2.0)"}],
        ["wma"]),
    "wn05_roc": ([{"roc": f"(close / nullif({lag('close', 10)}, 0) - 1) * 100"}], ["roc"]),
    "wn06_tr": ([{"tr": TR}], ["tr"]),
    "wn08_bb": (
        [{"bb_mid": roll("avg", "close", 20), "sd": roll("stddev_pop", "close", 20)}, {"bb_upper": "bb_mid + 2.0 * sd", "bb_lower": "bb_mid - 2.0 * sd"}, {"bb_width": over_zero("bb_upper - bb_lower", "bb_mid")}],
        ["bb_mid", "bb_upper", "bb_lower", "bb_width"]),
    "wn10_stoch": ([{"ll": roll("min", "low", 14), "hh": roll("max", "high", 14)}, {"stoch_k": over_zero("100 * (close - ll)", "hh - ll")}, {"stoch_d": roll("avg", "stoch_k", 3)}], ["stoch_k", "stoch_d"]),
    "wn11_obv": ([{"signed": f"coalesce(sign(close - {lag('close')}), 0) * volume"}, {"obv": running("sum(signed)")}], ["obv"]),
    "wn12_vwap": ([{"tp": TYPICAL}, {"tpv": "tp * volume"}, {"vwap": over_zero(roll("sum", "tpv", 20, full=False), roll("sum", "volume", 20, full=False))}], ["vwap"]),
    "wn13_return": ([{"ret": RETURN}], ["ret"]),
    "wn14_log_return": ([{"log_return": LOG_RETURN}], ["log_return"]),
    "wn15_volatility": ([{"r": RETURN}, {"volatility": roll("stddev_samp", "r", 20)}], ["volatility"]),
}

_BREAK = {"ma": sma(20)}
TREND = {
    "wt01_ma_distance": ([_BREAK, {"ma_distance_sma_20": over_zero("close", "ma") + " - 1"}], ["ma_distance_sma_20"]),
    "wt02_ma_cross_state": ([{"fast": sma(20), "slow": sma(50)}, {"ma_cross_state_sma_20_50": sign("fast", "slow")}], ["ma_cross_state_sma_20_50"]),
    "wt03_ma_cross_event": (
        [{"fast": sma(20), "slow": sma(50)}, {"pf": lag("fast"), "ps": lag("slow")},
         {"ma_cross_event_sma_20_50": "CASE WHEN pf <= ps AND fast > slow THEN CAST(1 AS DOUBLE) WHEN pf >= ps AND fast < slow THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"}],
        ["ma_cross_event_sma_20_50"]),
    "wt04_ma_slope": ([_BREAK, {"ma_slope_sma_20_5": over_zero(f"ma - {lag('ma', 5)}", "ma")}], ["ma_slope_sma_20_5"]),
    "wt05_price_above_ma": ([_BREAK, {"price_above_sma_20": flag("close > ma")}], ["price_above_sma_20"]),
    "wt06_bars_above_below_ma": (
        [_BREAK, {"side": "CASE WHEN close > ma THEN 1 WHEN close < ma THEN -1 ELSE 0 END"}, {"fresh": f"CASE WHEN side = {lag('side')} THEN 0 ELSE 1 END"}, {"run": running("sum(fresh)")},
         {"k": "row_number() OVER (PARTITION BY symbol, run ORDER BY ts)"}, {"bars_above_sma_20": "CASE WHEN side = 1 THEN k ELSE 0 END", "bars_below_sma_20": "CASE WHEN side = -1 THEN k ELSE 0 END"}],
        ["bars_above_sma_20", "bars_below_sma_20"]),
    "wt07_donchian": (
        [{"donchian_high_20": roll("max", "high", 20, full=False), "donchian_low_20": roll("min", "low", 20, full=False), "ph": roll("max", "high", 20, end=1, full=False), "pl": roll("min", "low", 20, end=1, full=False)},
         {"donchian_mid_20": "(donchian_high_20 + donchian_low_20) / 2", "donchian_width_20": over_zero("donchian_high_20 - donchian_low_20", "(donchian_high_20 + donchian_low_20) / 2"),
          "donchian_breakout_up_20": f"CASE WHEN ph IS NOT NULL THEN {flag('close > ph')} END", "donchian_breakout_down_20": f"CASE WHEN pl IS NOT NULL THEN {flag('close < pl')} END"}],
        ["donchian_high_20", "donchian_low_20", "donchian_mid_20", "donchian_width_20", "donchian_breakout_up_20", "donchian_breakout_down_20"]),
    "wt10_aroon": (
        [{"hs": "gather(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)", "ls": "gather(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)",
          "hh": roll("max", "high", 26), "ll": roll("min", "low", 26)},
         {"up_at": "CASE WHEN hh IS NOT NULL THEN array_position(hs, hh) END", "down_at": "CASE WHEN ll IS NOT NULL THEN array_position(ls, ll) END"},
         {"aroon_up_25": "(up_at - 1) * 100.0 / 25", "aroon_down_25": "(down_at - 1) * 100.0 / 25"}, {"aroon_osc_25": "aroon_up_25 - aroon_down_25"}],
        ["aroon_up_25", "aroon_down_25", "aroon_osc_25"]),
    "wt11_ichimoku": (
        [{f"ichimoku_{c}": f"({roll('max', 'high', n, full=False)} + {roll('min', 'low', n, full=False)}) / 2" for c, n in (("tenkan_9", 9), ("kijun_26", 26), ("senkou_b_raw", 52))},
         {"ichimoku_senkou_a_raw": "(ichimoku_tenkan_9 + ichimoku_kijun_26) / 2"},
         {"ichimoku_cloud_state": "CASE WHEN close > greatest(ichimoku_senkou_a_raw, ichimoku_senkou_b_raw) THEN 1 WHEN close < least(ichimoku_senkou_a_raw, ichimoku_senkou_b_raw) THEN -1 ELSE 0 END"}],
        ["ichimoku_tenkan_9", "ichimoku_kijun_26", "ichimoku_senkou_a_raw", "ichimoku_senkou_b_raw", "ichimoku_cloud_state"]),
    "wt13_linreg_slope": (
        [{"place": "CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE)"}, {"px": "place * close", "pp": "place * place"},
         {"n20": "count(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "sxy": roll("sum", "px", 20, full=False), "sx": roll("sum", "place", 20, full=False), "sy": roll("sum", "close", 20, full=False), "sxx": roll("sum", "pp", 20, full=False)},
         {"linreg_slope_20": "CASE WHEN n20 = 20 THEN (20 * sxy - sx * sy) / nullif(20 * sxx - sx * sx, 0) / nullif(sy / 20, 0) END"}],
        ["linreg_slope_20"]),
}

_TR = {"tr": TR}
MOMENTUM = {
    "wm01_momentum": ([{"momentum": f"close - {lag('close', 10)}"}], ["momentum"]),
    "wm02_roc_pct": ([{"roc_pct": f"close / nullif({lag('close', 10)}, 0) - 1"}], ["roc_pct"]),
    "wm04_stoch_enhanced": (
        [*NATIVE["wn10_stoch"][0], {"stoch_state": f"CASE WHEN stoch_k IS NOT NULL AND stoch_d IS NOT NULL THEN {sign('stoch_k', 'stoch_d')} END", "pk": lag("stoch_k"), "pd": lag("stoch_d")},
         {"stoch_cross_event": "CASE WHEN pk <= pd AND stoch_k > stoch_d THEN 1 WHEN pk >= pd AND stoch_k < stoch_d THEN -1 ELSE 0 END"}],
        ["stoch_k", "stoch_d", "stoch_state", "stoch_cross_event"]),
    "wm05_williams_r": ([{"ll": roll("min", "low", 14), "hh": roll("max", "high", 14)}, {"williams_r": over_zero("-100 * (hh - close)", "hh - ll")}], ["williams_r"]),
    "wm06_cci": (
        [{"tp": TYPICAL}, {"mean": roll("avg", "tp", 20), **{f"p{i}": (lag("tp", i) if i else "tp") for i in range(20)}},
         {"mad": "(" + " + ".join(f"abs(p{i} - mean)" for i in range(20)) + ") / 20"}, {"cci": over_zero("tp - mean", "0.015 * mad")}],
        ["cci"]),
    "wm07_mfi": (
        [{"tp": TYPICAL}, {"d": f"tp - {lag('tp')}", "flow": "tp * volume"}, {"pos": "CASE WHEN d > 0 THEN flow ELSE 0 END", "neg": "CASE WHEN d < 0 THEN flow ELSE 0 END"},
         {"ps": roll("sum", "pos", 14), "ns": roll("sum", "neg", 14)}, {"mfi": "CASE WHEN ns = 0 THEN 100 ELSE 100 - 100 / (1 + ps / nullif(ns, 0)) END"}],
        ["mfi"]),
    "wm09_ultimate_osc": (
        [{"pc": lag("close")}, {"bp": "close - least(low, pc)", "tr": "greatest(high, pc) - least(low, pc)"}, {f"a{n}": over_zero(roll("sum", "bp", n), roll("sum", "tr", n)) for n in (7, 14, 28)},
         {"ultimate_osc": "100 * (4 * a7 + 2 * a14 + a28) / 7"}],
        ["ultimate_osc"]),
    "wm11_kst": (
        [{f"r{i}": f"(close / nullif({lag('close', n)}, 0) - 1) * 100" for i, n in ((1, 10), (2, 15), (3, 20), (4, 30))}, {f"m{i}": roll("avg", f"r{i}", n) for i, n in ((1, 10), (2, 10), (3, 10), (4, 15))},
         {"kst": "m1 + 2 * m2 + 3 * m3 + 4 * m4"}, {"kst_signal": roll("avg", "kst", 9)}, {"kst_hist": "kst - kst_signal"}],
        ["kst", "kst_signal", "kst_hist"]),
}


def _mapped(z: str) -> str:
    return f"{clip(z, 0, 3)} / 3.0 * 100.0"


_ATR_PCT = [_TR, {"atr_pct": over_zero(roll("avg", "tr", 14), "close")}]
_BB_WIDTH = NATIVE["wn08_bb"][0]
_RANGE = [{"range_pct": over_zero("high - low", "close")}]
_GAP = [{"gap_pct": f"open / nullif({lag('close')}, 0) - 1"}, {"abs_gap_pct": "abs(gap_pct)"}]
_HIST = [{"lr": LOG_RETURN}, {"hist_vol": f"{roll('stddev_samp', 'lr', 20)} * sqrt({YEAR})"}]
VOLATILITY = {
    "wv01_atr_pct": (_ATR_PCT, ["atr_pct"]),
    "wv02_normalized_true_range": ([_TR, {"ntr": over_zero("tr", "close")}, {"ntr_ma": roll("avg", "ntr", 14)}], ["ntr", "ntr_ma"]),
    "wv03_historical_volatility": (_HIST, ["hist_vol"]),
    "wv04_realized_volatility": ([{"lr": LOG_RETURN}, {"lr2": "lr * lr"}, {"realized_vol": f"sqrt({roll('sum', 'lr2', 20)}) * sqrt({YEAR} / 20.0)"}], ["realized_vol"]),
    "wv05_parkinson_volatility": ([{"x": "CASE WHEN high > 0 AND low > 0 THEN ln(high / low) * ln(high / low) END"}, {"parkinson_vol": f"sqrt({roll('avg', 'x', 20)} * {YEAR} / (4 * ln(2)))"}], ["parkinson_vol"]),
    "wv06_garman_klass_volatility": (
        [{"x": "CASE WHEN high > 0 AND low > 0 AND open > 0 AND close > 0 THEN 0.5 * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open) END"}, {"m": roll("avg", "x", 20)},
         {"garman_klass_vol": f"CASE WHEN m IS NOT NULL THEN sqrt(greatest(0, m * {YEAR})) END"}],
        ["garman_klass_vol"]),
    "wv07_rogers_satchell_volatility": (
        [{"x": "CASE WHEN high > 0 AND low > 0 AND open > 0 AND close > 0 THEN ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) END"}, {"m": roll("avg", "x", 20)},
         {"rogers_satchell_vol": f"CASE WHEN m IS NOT NULL THEN sqrt(greatest(0, m * {YEAR})) END"}],
        ["rogers_satchell_vol"]),
    "wv08_range_percent": ([*_RANGE, {"range_pct_ma": roll("avg", "range_pct", 20), "range_pct_zscore": zscore("range_pct", 20)}], ["range_pct", "range_pct_ma", "range_pct_zscore"]),
    "wv09_gap_percent": ([*_GAP, {"gap_pct_ma": roll("avg", "abs_gap_pct", 20), "gap_pct_zscore": zscore("abs_gap_pct", 20)}], ["gap_pct", "abs_gap_pct", "gap_pct_ma", "gap_pct_zscore"]),
    "wv10_bb_width_percentile": ([*_BB_WIDTH, *rank_layers("bb_width_percentile", "bb_width", 100)], ["bb_width_percentile"]),
    "wv11_atr_percentile": ([*_ATR_PCT, *rank_layers("atr_pct_percentile", "atr_pct", 100)], ["atr_pct_percentile"]),
    "wv12_volatility_zscore": ([*_HIST, {"vol_zscore": zscore("hist_vol", 100)}], ["vol_zscore"]),
    "wv13_volatility_compression": (
        [*_BB_WIDTH, *_ATR_PCT, *rank_layers("br", "bb_width", 100), *rank_layers("ar", "atr_pct", 100), {"vol_compression_score": clip("100.0 - (br + ar) / 2.0", 0, 100)}], ["vol_compression_score"]),
    "wv14_volatility_expansion": (
        [*_BB_WIDTH, *_ATR_PCT, *_RANGE, *rank_layers("br", "bb_width", 100), *rank_layers("ar", "atr_pct", 100), {"rz": zscore("range_pct", 20)}, {"vol_expansion_score": clip(f"(br + ar + {_mapped('rz')}) / 3.0", 0, 100)}],
        ["vol_expansion_score"]),
    "wv15_volatility_regime": (
        [*_HIST, *rank_layers("vol_regime_percentile", "hist_vol", 252), {"vol_regime_state": "CASE WHEN vol_regime_percentile < 33.33 THEN 0 WHEN vol_regime_percentile < 66.66 THEN 1 WHEN vol_regime_percentile IS NOT NULL THEN 2 END"}],
        ["vol_regime_percentile", "vol_regime_state"]),
    "wv16_volatility_composite": (
        [*_BB_WIDTH, *_ATR_PCT, *_HIST, *_RANGE, *_GAP, *rank_layers("br", "bb_width", 100), *rank_layers("ar", "atr_pct", 100), *rank_layers("hr", "hist_vol", 100), {"rz": zscore("range_pct", 20), "gz": zscore("abs_gap_pct", 20)},
         {"volatility_risk_score": clip(f"({_mapped('rz')} + {_mapped('gz')} + ar) / 3.0", 0, 100), "volatility_regime_score": clip("(hr + br + ar) / 3.0", 0, 100)}],
        ["volatility_risk_score", "volatility_regime_score"]),
}

_MFV = {"mfv": f"{MONEY_MULTIPLIER} * volume"}
_CMF = [_MFV, {"cmf": over_zero(roll("sum", "mfv", 20), roll("sum", "volume", 20))}]
VOLUME = {
    "wq01_volume_sma": ([{"volume_sma": roll("avg", "volume", 20)}], ["volume_sma"]),
    "wq03_volume_ratio": ([{"volume_ratio": over_zero("volume", roll("avg", "volume", 20))}], ["volume_ratio"]),
    "wq04_volume_roc": ([{"volume_roc": f"volume / nullif({lag('volume', 10)}, 0) - 1"}], ["volume_roc"]),
    "wq05_volume_zscore": ([{"volume_zscore": zscore("volume", 20)}], ["volume_zscore"]),
    "wq06_volume_spike": ([{"base": roll("avg", "volume", 20, end=1)}, {"volume_spike": f"CASE WHEN base IS NOT NULL THEN {flag('volume > 2.0 * base')} END", "volume_spike_ratio": over_zero("volume", "base")}], ["volume_spike", "volume_spike_ratio"]),
    "wq07_turnover": ([{"turnover_try": "close * volume"}, {"turnover_try_sma": roll("avg", "turnover_try", 20, full=False)}], ["turnover_try", "turnover_try_sma"]),
    "wq08_vwma": ([{"cv": "close * volume"}, {"vwma": over_zero(roll("sum", "cv", 20), roll("sum", "volume", 20))}], ["vwma"]),
    "wq09_vwma_distance": ([{"cv": "close * volume"}, {"vwma": over_zero(roll("sum", "cv", 20), roll("sum", "volume", 20))}, {"vwma_distance": over_zero("close", "vwma") + " - 1"}], ["vwma_distance"]),
    "wq10_adl": ([_MFV, {"adl": running("sum(mfv)")}], ["adl"]),
    "wq11_cmf": (_CMF, ["cmf"]),
    "wq13_pvt": ([{"step": f"volume * coalesce({RETURN}, 0)"}, {"pvt": running("sum(step)")}], ["pvt"]),
    "wq15_ease_of_movement": (
        [{"mid": "(high + low) / 2"}, {"eom": over_zero(f"(mid - {lag('mid')}) * (high - low)", "volume")}, {"eom_sma": roll("avg", "eom", 14)}], ["eom / 1000000.0 AS eom_millions", "eom_sma / 1000000.0 AS eom_sma_millions"]),
    "wq16_nvi": (
        [{"r": f"coalesce({RETURN}, 0)", "dv": f"volume - {lag('volume')}"}, {"step": "CASE WHEN dv < 0 AND r > -1 THEN ln(1 + r) ELSE 0 END"}, {"total": running("sum(step)")},
         {"log_nvi": "CASE WHEN dv IS NOT NULL THEN ln(1000) + total END"}],
        ["log_nvi"]),
    "wq17_pvi": (
        [{"r": f"coalesce({RETURN}, 0)", "dv": f"volume - {lag('volume')}"}, {"step": "CASE WHEN dv > 0 AND r > -1 THEN ln(1 + r) ELSE 0 END"}, {"total": running("sum(step)")},
         {"log_pvi": "CASE WHEN dv IS NOT NULL THEN ln(1000) + total END"}],
        ["log_pvi"]),
    "wq19_vwap_enhanced": ([{"tp": TYPICAL}, {"tpv": "tp * volume"}, {"vwap": over_zero(roll("sum", "tpv", 20), roll("sum", "volume", 20))}, {"vwap_distance": over_zero("close", "vwap") + " - 1"}], ["vwap", "vwap_distance"]),
    "wq20_obv_enhanced": ([*NATIVE["wn11_obv"][0], {"obv_slope": f"obv - {lag('obv', 5)}"}, {"obv_direction": "sign(obv_slope)"}], ["obv", "obv_slope", "CAST(obv_direction AS DOUBLE) AS obv_direction"]),
    "wq21_volume_breakout": (
        [{"ph": roll("max", "high", 20, end=1), "base": roll("avg", "volume", 20, end=1)},
         {"volume_breakout_confirm": f"CASE WHEN ph IS NOT NULL AND base IS NOT NULL THEN {flag('close > ph AND volume > 1.5 * base')} END",
          "volume_breakout_score": clip("greatest(close / nullif(ph, 0) - 1, 0) * 1000 + greatest(volume / nullif(base, 0), 0) * 10", 0, 100)}],
        ["volume_breakout_confirm", "CASE WHEN ph IS NOT NULL AND base IS NOT NULL THEN volume_breakout_score END AS volume_breakout_score"]),
    "wq22_liquidity_score": ([{"t": "close * volume"}, {"liquidity_turnover_sma": roll("avg", "t", 20)}, {"liquidity_score": clip("liquidity_turnover_sma / 1000000.0 * 50", 0, 100)}], ["liquidity_turnover_sma", "liquidity_score"]),
    "wq23_volume_composite": (
        [*_CMF, {"z": zscore("volume", 20)}, {"volume_activity_score": clip("(z + 3) * (100 / 6.0)", 0, 100), "volume_pressure_score": clip("cmf * 100", -100, 100)}], ["volume_activity_score", "volume_pressure_score"]),
}

INDICATORS = NATIVE | TREND | MOMENTUM | VOLATILITY | VOLUME
