"""Indicators that need recursive smoothing: layers as in indicators.py, smoothing ones as {column: (input, alpha, least)}."""

from __future__ import annotations

from barloom.operators.indicators import MONEY_MULTIPLIER, RETURN, TR, TYPICAL, clip, flag, lag, over_zero, roll, running, sign, sma


def span(n: int) -> float:
    return 2 / (n + 1)


def _gain_loss(column: str = "close", tag: str = "") -> dict:
    d = f"({column} - {lag(column)})"
    return {f"gain{tag}": f"greatest({d}, 0 * {d})", f"loss{tag}": f"greatest(-{d}, 0 * {d})"}


def _rsi(gain: str, loss: str) -> str:
    return f"CASE WHEN {loss} = 0 THEN CASE WHEN {gain} = 0 THEN CAST(50 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END ELSE 100 - 100 / (1 + {gain} / nullif({loss}, 0)) END"


def _plain_rsi(gain: str, loss: str) -> str:
    """100 without losses, null where nothing moved."""
    return f"CASE WHEN {loss} = 0 THEN CASE WHEN {gain} > 0 THEN CAST(100 AS DOUBLE) END ELSE 100 - 100 / (1 + {gain} / nullif({loss}, 0)) END"


_DIRECTED = [
    {"up": f"high - {lag('high')}", "down": f"{lag('low')} - low", "tr": TR},
    {"plus_dm": "CASE WHEN up > down AND up > 0 THEN up ELSE 0 END", "minus_dm": "CASE WHEN down > up AND down > 0 THEN down ELSE 0 END"},
    {"atr": ("tr", 1 / 14, 1), "ps": ("plus_dm", 1 / 14, 1), "ms": ("minus_dm", 1 / 14, 1)},
    {"plus_di": over_zero("100 * ps", "atr"), "minus_di": over_zero("100 * ms", "atr")},
    {"dx": over_zero("100 * abs(plus_di - minus_di)", "(plus_di + minus_di)")},
    {"adx": ("dx", 1 / 14, 1)},
]
_STREAK = [
    {"side": f"CASE WHEN close > {lag('close')} THEN 1 WHEN close < {lag('close')} THEN -1 ELSE 0 END"},
    {"fresh": f"CASE WHEN side = {lag('side')} THEN 0 ELSE 1 END"},
    {"run": running("sum(fresh)")},
    {"streak": "CAST(side * row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS DOUBLE)"},
]

SMOOTHED = {
    "wn02_ema": ([{"ema": ("close", span(20), 0)}], ["ema"]),
    "wn04_rsi": ([_gain_loss(), {"g": ("gain", 1 / 14, 14), "l": ("loss", 1 / 14, 14)}, {"rsi": _rsi("g", "l")}], ["rsi"]),
    "wn07_atr": ([{"tr": TR}, {"atr": ("tr", 1 / 14, 14)}], ["atr"]),
    "wn09_macd": ([{"f": ("close", span(12), 0), "s": ("close", span(26), 0)}, {"macd": "f - s"}, {"macd_signal": ("macd", span(9), 0)}, {"macd_hist": "macd - macd_signal"}], ["macd", "macd_signal", "macd_hist"]),
    "wt08_keltner": (
        [{"tr": TR}, {"mid": ("close", span(20), 0), "atr": ("tr", 1 / 14, 0)}, {"upper_band": "mid + 2.0 * atr", "lower_band": "mid - 2.0 * atr"}],
        ["mid AS keltner_mid_20", "upper_band AS keltner_upper", "lower_band AS keltner_lower", "(upper_band - lower_band) / nullif(mid, 0) AS keltner_width", "(close - lower_band) / nullif(upper_band - lower_band, 0) AS keltner_position"]),
    "wt09_adx": (
        [*_DIRECTED, {"dmi_state": f"CASE WHEN plus_di IS NOT NULL AND minus_di IS NOT NULL THEN {sign('plus_di', 'minus_di')} END"}],
        ["plus_di AS plus_di_14", "minus_di AS minus_di_14", "adx AS adx_14", "dmi_state AS dmi_state_14"]),
    "wt14_trend_strength": (
        [{f"m{n}": sma(n) for n in (20, 50, 200)}, {"d20": f"m20 - {lag('m20')}", "d50": f"m50 - {lag('m50')}"}, *_DIRECTED,
         {"votes": " + ".join(f"CASE WHEN {c} THEN {w} ELSE -{w} END" for c, w in (("close > m20", 1), ("close > m50", 1), ("close > m200", 1), ("m20 > m50", 1), ("m50 > m200", 1), ("m20 > m200", 1), ("plus_di > minus_di", 2), ("d20 > 0", 1), ("d50 > 0", 1)))},
         {"trend_direction_score": "CASE WHEN adx IS NOT NULL THEN votes * 10.0 END"}, {"trend_strength_score": clip("adx * abs(trend_direction_score) / 100", 0, 100)}],
        ["trend_strength_score", "CAST(trend_direction_score AS DOUBLE) AS trend_direction_score"]),
    "wm03_rsi_enhanced": (
        [_gain_loss(), {"g": ("gain", 1 / 14, 0), "l": ("loss", 1 / 14, 0)}, {"rsi": _plain_rsi("g", "l")}, {"rsi_slope": f"rsi - {lag('rsi', 3)}"},
         {"rsi_zone": "CASE WHEN rsi > 70 THEN 1 WHEN rsi < 30 THEN -1 ELSE 0 END", "rsi_above_50": "CASE WHEN rsi > 50 THEN 1 ELSE 0 END"}],
        ["rsi", "rsi_slope", "rsi_zone", "rsi_above_50"]),
    "wm08_tsi": (
        [{"d": f"close - {lag('close')}"}, {"ad": "abs(d)"}, {"d1": ("d", span(25), 0), "a1": ("ad", span(25), 0)}, {"one": "1"}, {"d2": ("d1", span(13), 0), "a2": ("a1", span(13), 0)},
         {"tsi": over_zero("100 * d2", "a2")}, {"tsi_signal": ("tsi", span(7), 0)}, {"tsi_hist": "tsi - tsi_signal"}],
        ["tsi", "tsi_signal", "tsi_hist"]),
    "wm10_ppo": ([{"f": ("close", span(12), 0), "s": ("close", span(26), 0)}, {"ppo": over_zero("100 * (f - s)", "s")}, {"ppo_signal": ("ppo", span(9), 0)}, {"ppo_hist": "ppo - ppo_signal"}], ["ppo", "ppo_signal", "ppo_hist"]),
    "wm12_connors_rsi": (
        [*_STREAK, {"r": RETURN}, {"rs": "gather(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)", "n": "count(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"},
         {"place": "CASE WHEN n = 100 THEN length_of(kept_in(rs, v -> v < r)) + (length_of(kept_in(rs, v -> v = r)) + 1) / 2.0 END"},
         _gain_loss() | _gain_loss("streak", "2"), {"g": ("gain", 1 / 3, 0), "l": ("loss", 1 / 3, 0), "g2": ("gain2", 1 / 2, 0), "l2": ("loss2", 1 / 2, 0)},
         {"connors_rsi": f"({_plain_rsi('g', 'l')} + {_plain_rsi('g2', 'l2')} + place) / 3"}],
        ["connors_rsi"]),
    "wm13_momentum_strength": (
        [{"roc": f"close / nullif({lag('close', 10)}, 0) - 1", "ll": roll("min", "low", 14), "hh": roll("max", "high", 14), "tp": TYPICAL}, {"k": over_zero("100 * (close - ll)", "hh - ll"), "d": f"tp - {lag('tp')}"},
         {"kd": roll("avg", "k", 3), "pos": "CASE WHEN d > 0 THEN tp * volume ELSE 0 END", "neg": "CASE WHEN d < 0 THEN tp * volume ELSE 0 END"}, {"ps": roll("sum", "pos", 14), "ns": roll("sum", "neg", 14)},
         {"mfi": "CASE WHEN ns = 0 THEN 100 ELSE 100 - 100 / (1 + ps / nullif(ns, 0)) END"}, _gain_loss(), {"g": ("gain", 1 / 14, 0), "l": ("loss", 1 / 14, 0)}, {"rsi": _plain_rsi("g", "l")},
         {"bull": " + ".join(flag(c) for c in ("rsi > 50", "roc > 0", "k > kd", "mfi > 50")), "bear": " + ".join(flag(c) for c in ("rsi < 50", "roc < 0", "k < kd", "mfi < 50"))}],
        ["(bull + bear) / 4 * 100 AS momentum_strength_score", "(bull - bear) / 4 * 100 AS momentum_direction_score"]),
    "wq02_volume_ema": ([{"volume_ema": ("volume", span(20), 20)}], ["volume_ema"]),
    "wq12_chaikin_osc": ([{"mfv": f"{MONEY_MULTIPLIER} * volume"}, {"adl": running("sum(mfv)")}, {"f": ("adl", span(3), 3), "s": ("adl", span(10), 10)}], ["f - s AS chaikin_osc"]),
    "wq14_force_index": ([{"force_index": f"(close - {lag('close')}) * volume"}, {"force_index_ema": ("force_index", span(13), 13)}], ["force_index", "force_index_ema"]),
    "wq18_kvo": (
        [{"tp": TYPICAL}, {"vf": f"volume * abs(2 * (tp - {lag('tp')})) * sign(tp - {lag('tp')})"}, {"f": ("vf", span(34), 34), "s": ("vf", span(55), 55)}, {"kvo": "f - s"}, {"kvo_signal": ("kvo", span(13), 13)}],
        ["kvo", "kvo_signal", "kvo - kvo_signal AS kvo_hist"]),
}
