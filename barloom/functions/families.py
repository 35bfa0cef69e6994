"""Families of indicators with parameters: trend, momentum, volatility, volume, candles and signals. Each is registered
with the requests of functions/indicators.py; intermediate columns carry the name of the request's column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.functions.indicators import INDICATORS, _window, indicator, request_in_one_pass
from barloom.operators.indicators import LOG_RETURN, MONEY_MULTIPLIER, RETURN, TR, TYPICAL, YEAR
from barloom.operators.smoothed import span
from barloom.plans.layers import clip, flag, lag, over_zero, roll, running, sign
from barloom.sources.bars import BARS, BARS_SQL

_PLACE = "CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE)"


# Averages and trend.
@indicator
def wma(column: str, window: int = 20, of: str = "close"):
    """Linear weights, the newest value the heaviest; a shorter start is weighted alike."""
    n, c = _window(window), column
    return [
        {f"{c}_place": _PLACE},
        {f"{c}_px": f"{c}_place * {of}"},
        {f"{c}_sx": roll("sum", f"{c}_px", n, full=False), f"{c}_s": roll("sum", of, n, full=False), f"{c}_n": f"least({c}_place, {n})"},
        {c: f"({c}_sx - ({c}_place - {c}_n) * {c}_s) / ({c}_n * ({c}_n + 1) / 2.0)"},
    ], [c]


@indicator
def vwma(column: str, window: int = 20):
    n, c = _window(window), column
    return [{f"{c}_cv": "close * volume"}, {c: over_zero(roll("sum", f"{c}_cv", n), roll("sum", "volume", n))}], [c]


@indicator
def macd(column: str, fast: int = 12, slow: int = 26, signal: int = 9):
    f, s, c = _window(fast), _window(slow), column
    if f >= s:
        raise ValueError("the fast window is the shorter one")
    return [{f"{c}_f": ("close", span(f), 0), f"{c}_s": ("close", span(s), 0)}, {f"{c}_line": f"{c}_f - {c}_s"}, {f"{c}_signal": (f"{c}_line", span(_window(signal)), 0)}, {f"{c}_hist": f"{c}_line - {c}_signal"}], [f"{c}_line", f"{c}_signal", f"{c}_hist"]


@indicator
def ppo(column: str, fast: int = 12, slow: int = 26, signal: int = 9):
    f, s, c = _window(fast), _window(slow), column
    return [{f"{c}_f": ("close", span(f), 0), f"{c}_s": ("close", span(s), 0)}, {f"{c}_line": over_zero(f"100 * ({c}_f - {c}_s)", f"{c}_s")}, {f"{c}_signal": (f"{c}_line", span(_window(signal)), 0)}, {f"{c}_hist": f"{c}_line - {c}_signal"}], [f"{c}_line", f"{c}_signal", f"{c}_hist"]


@indicator
def keltner(column: str, window: int = 20, atr_window: int = 14, width: float = 2.0):
    c = column
    return [{f"{c}_tr": TR}, {f"{c}_mid": ("close", span(_window(window)), 0), f"{c}_atr": (f"{c}_tr", 1 / _window(atr_window), 0)}, {f"{c}_upper": f"{c}_mid + {float(width)} * {c}_atr", f"{c}_lower": f"{c}_mid - {float(width)} * {c}_atr"}], [f"{c}_mid", f"{c}_upper", f"{c}_lower"]


@indicator
def adx(column: str, window: int = 14):
    a, c = 1 / _window(window), column
    return [
        {f"{c}_up": f"high - {lag('high')}", f"{c}_down": f"{lag('low')} - low", f"{c}_tr": TR},
        {f"{c}_pdm": f"CASE WHEN {c}_up > {c}_down AND {c}_up > 0 THEN {c}_up ELSE 0 END", f"{c}_mdm": f"CASE WHEN {c}_down > {c}_up AND {c}_down > 0 THEN {c}_down ELSE 0 END"},
        {f"{c}_atr": (f"{c}_tr", a, 1), f"{c}_ps": (f"{c}_pdm", a, 1), f"{c}_ms": (f"{c}_mdm", a, 1)},
        {f"{c}_plus": over_zero(f"100 * {c}_ps", f"{c}_atr"), f"{c}_minus": over_zero(f"100 * {c}_ms", f"{c}_atr")},
        {f"{c}_dx": over_zero(f"100 * abs({c}_plus - {c}_minus)", f"({c}_plus + {c}_minus)")},
        {c: (f"{c}_dx", a, 1)},
    ], [c, f"{c}_plus", f"{c}_minus"]


@indicator
def aroon(column: str, window: int = 25):
    n, c = _window(window), column
    frame = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
    return [
        {f"{c}_hs": f"gather(high) {frame}", f"{c}_ls": f"gather(low) {frame}", f"{c}_hh": roll("max", "high", n + 1), f"{c}_ll": roll("min", "low", n + 1)},
        {f"{c}_up": f"CASE WHEN {c}_hh IS NOT NULL THEN (array_position({c}_hs, {c}_hh) - 1) * 100.0 / {n} END", f"{c}_down": f"CASE WHEN {c}_ll IS NOT NULL THEN (array_position({c}_ls, {c}_ll) - 1) * 100.0 / {n} END"},
        {f"{c}_osc": f"{c}_up - {c}_down"},
    ], [f"{c}_up", f"{c}_down", f"{c}_osc"]


@indicator
def ichimoku(column: str, conversion: int = 9, base: int = 26, leading: int = 52):
    c, middle = column, lambda n: f"({roll('max', 'high', _window(n), full=False)} + {roll('min', 'low', _window(n), full=False)}) / 2"
    a, b = f"{c}_a", f"{c}_b"
    return [{f"{c}_tenkan": middle(conversion), f"{c}_kijun": middle(base), b: middle(leading)}, {a: f"({c}_tenkan + {c}_kijun) / 2"}, {f"{c}_cloud": f"CASE WHEN close > greatest({a}, {b}) THEN 1 WHEN close < least({a}, {b}) THEN -1 ELSE 0 END"}], [f"{c}_tenkan", f"{c}_kijun", a, b, f"{c}_cloud"]


@indicator
def slope(column: str, window: int = 20):
    """Slope of the least-squares line through the closes, as a share of their mean."""
    n, c = _window(window, 2), column
    return [
        {f"{c}_place": _PLACE},
        {f"{c}_px": f"{c}_place * close", f"{c}_pp": f"{c}_place * {c}_place"},
        {f"{c}_sxy": roll("sum", f"{c}_px", n), f"{c}_sx": roll("sum", f"{c}_place", n), f"{c}_sy": roll("sum", "close", n), f"{c}_sxx": roll("sum", f"{c}_pp", n)},
        {c: f"({n} * {c}_sxy - {c}_sx * {c}_sy) / nullif({n} * {c}_sxx - {c}_sx * {c}_sx, 0) / nullif({c}_sy / {n}, 0)"},
    ], [c]


@indicator
def ma_slope(column: str, window: int = 20, bars: int = 5):
    c = column
    return [{f"{c}_ma": roll("avg", "close", _window(window), full=False)}, {c: over_zero(f"{c}_ma - {lag(f'{c}_ma', _window(bars))}", f"{c}_ma")}], [c]


@indicator
def ma_cross(column: str, fast: int = 20, slow: int = 50):
    """state: 1 where the fast average is above the slow one, -1 below; event: the same at the bar where it changes."""
    c = column
    f, s = f"{c}_f", f"{c}_s"
    return [
        {f: roll("avg", "close", _window(fast), full=False), s: roll("avg", "close", _window(slow), full=False)},
        {f"{c}_pf": lag(f), f"{c}_ps": lag(s), f"{c}_state": sign(f, s)},
        {f"{c}_event": f"CASE WHEN {c}_pf <= {c}_ps AND {f} > {s} THEN 1.0 WHEN {c}_pf >= {c}_ps AND {f} < {s} THEN -1.0 ELSE 0.0 END"},
    ], [f"{c}_state", f"{c}_event"]


@indicator
def above_ma(column: str, window: int = 20):
    """Bars in a row above the average and below it."""
    c = column
    return [
        {f"{c}_ma": roll("avg", "close", _window(window), full=False)},
        {f"{c}_side": f"CASE WHEN close > {c}_ma THEN 1 WHEN close < {c}_ma THEN -1 ELSE 0 END"},
        {f"{c}_fresh": f"CASE WHEN {c}_side = {lag(f'{c}_side')} THEN 0 ELSE 1 END"},
        {f"{c}_run": running(f"sum({c}_fresh)")},
        {f"{c}_k": f"row_number() OVER (PARTITION BY symbol, {c}_run ORDER BY ts)"},
        {f"{c}_above": f"CASE WHEN {c}_side = 1 THEN {c}_k ELSE 0 END", f"{c}_below": f"CASE WHEN {c}_side = -1 THEN {c}_k ELSE 0 END"},
    ], [f"{c}_above", f"{c}_below"]


# Momentum.
@indicator
def momentum(column: str, window: int = 10):
    return [{column: f"close - {lag('close', _window(window))}"}], [column]


@indicator
def williams(column: str, window: int = 14):
    n, c = _window(window), column
    return [{f"{c}_ll": roll("min", "low", n), f"{c}_hh": roll("max", "high", n)}, {c: over_zero(f"-100 * ({c}_hh - close)", f"{c}_hh - {c}_ll")}], [c]


@indicator
def cci(column: str, window: int = 20, constant: float = 0.015):
    n, c = _window(window), column
    return [
        {f"{c}_tp": TYPICAL},
        {f"{c}_mean": roll("avg", f"{c}_tp", n), **{f"{c}_{i}": lag(f"{c}_tp", i) if i else f"{c}_tp" for i in range(n)}},
        {f"{c}_mad": "(" + " + ".join(f"abs({c}_{i} - {c}_mean)" for i in range(n)) + f") / {n}"},
        {c: over_zero(f"{c}_tp - {c}_mean", f"{float(constant)} * {c}_mad")},
    ], [c]


@indicator
def mfi(column: str, window: int = 14):
    n, c = _window(window), column
    return [
        {f"{c}_tp": TYPICAL},
        {f"{c}_d": f"{c}_tp - {lag(f'{c}_tp')}", f"{c}_flow": f"{c}_tp * volume"},
        {f"{c}_pos": f"CASE WHEN {c}_d > 0 THEN {c}_flow ELSE 0 END", f"{c}_neg": f"CASE WHEN {c}_d < 0 THEN {c}_flow ELSE 0 END"},
        {f"{c}_ps": roll("sum", f"{c}_pos", n), f"{c}_ns": roll("sum", f"{c}_neg", n)},
        {c: f"CASE WHEN {c}_ns = 0 THEN 100 ELSE 100 - 100 / (1 + {c}_ps / nullif({c}_ns, 0)) END"},
    ], [c]


@indicator
def tsi(column: str, slow: int = 25, fast: int = 13, signal: int = 7):
    a, b, c = span(_window(slow)), span(_window(fast)), column
    return [
        {f"{c}_d": f"close - {lag('close')}"},
        {f"{c}_ad": f"abs({c}_d)"},
        {f"{c}_d1": (f"{c}_d", a, 0), f"{c}_a1": (f"{c}_ad", a, 0)},
        {f"{c}_one": "1"},
        {f"{c}_d2": (f"{c}_d1", b, 0), f"{c}_a2": (f"{c}_a1", b, 0)},
        {f"{c}_line": over_zero(f"100 * {c}_d2", f"{c}_a2")},
        {f"{c}_signal": (f"{c}_line", span(_window(signal)), 0)},
        {f"{c}_hist": f"{c}_line - {c}_signal"},
    ], [f"{c}_line", f"{c}_signal", f"{c}_hist"]


@indicator
def ultimate(column: str, short: int = 7, middle: int = 14, long: int = 28):
    c, windows = column, tuple(map(_window, (short, middle, long)))
    return [
        {f"{c}_pc": lag("close")},
        {f"{c}_bp": f"close - least(low, {c}_pc)", f"{c}_tr": f"greatest(high, {c}_pc) - least(low, {c}_pc)"},
        {f"{c}_{i}": over_zero(roll("sum", f"{c}_bp", n), roll("sum", f"{c}_tr", n)) for i, n in enumerate(windows)},
        {c: f"100 * (4 * {c}_0 + 2 * {c}_1 + {c}_2) / 7"},
    ], [c]


@indicator
def kst(column: str, spans: tuple = (10, 15, 20, 30), means: tuple = (10, 10, 10, 15), signal: int = 9):
    c = column
    if len(spans) != 4 or len(means) != 4:
        raise ValueError("four spans and four means")
    return [
        {f"{c}_r{i}": f"(close / nullif({lag('close', _window(n))}, 0) - 1) * 100" for i, n in enumerate(spans)},
        {f"{c}_m{i}": roll("avg", f"{c}_r{i}", _window(n)) for i, n in enumerate(means)},
        {f"{c}_line": " + ".join(f"{i + 1} * {c}_m{i}" for i in range(4))},
        {f"{c}_signal": roll("avg", f"{c}_line", _window(signal))},
        {f"{c}_hist": f"{c}_line - {c}_signal"},
    ], [f"{c}_line", f"{c}_signal", f"{c}_hist"]


# Volatility.
@indicator
def atr_pct(column: str, window: int = 14):
    return [{f"{column}_tr": TR}, {column: over_zero(roll("avg", f"{column}_tr", _window(window)), "close")}], [column]


@indicator
def historical(column: str, window: int = 20, year: int = YEAR):
    return [{f"{column}_lr": LOG_RETURN}, {column: f"{roll('stddev_samp', f'{column}_lr', _window(window, 2))} * sqrt({_window(year)})"}], [column]


@indicator
def realized(column: str, window: int = 20, year: int = YEAR):
    n = _window(window)
    return [{f"{column}_lr": LOG_RETURN}, {f"{column}_sq": f"{column}_lr * {column}_lr"}, {column: f"sqrt({roll('sum', f'{column}_sq', n)}) * sqrt({_window(year)} / {float(n)})"}], [column]


def _range_based(column: str, square: str, needed: tuple, n: int, year: int, scale: str = "1"):
    positive = " AND ".join(f"{x} > 0" for x in needed)
    return [{f"{column}_x": f"CASE WHEN {positive} THEN {square} END"}, {f"{column}_m": roll("avg", f"{column}_x", n)}, {column: f"CASE WHEN {column}_m IS NOT NULL THEN sqrt(greatest(0, {column}_m * {year} / ({scale}))) END"}], [column]


@indicator
def parkinson(column: str, window: int = 20, year: int = YEAR):
    return _range_based(column, "ln(high / low) * ln(high / low)", ("high", "low"), _window(window), _window(year), "4 * ln(2)")


@indicator
def garman_klass(column: str, window: int = 20, year: int = YEAR):
    return _range_based(column, "0.5 * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open)", ("high", "low", "open", "close"), _window(window), _window(year))


@indicator
def rogers_satchell(column: str, window: int = 20, year: int = YEAR):
    return _range_based(column, "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)", ("high", "low", "open", "close"), _window(window), _window(year))


@indicator
def range_pct(column: str, window: int = 20):
    """Range over close, with its mean."""
    return [{column: over_zero("high - low", "close")}, {f"{column}_mean": roll("avg", column, _window(window))}], [column, f"{column}_mean"]


@indicator
def gap_pct(column: str, window: int = 20):
    return [{column: f"open / nullif({lag('close')}, 0) - 1"}, {f"{column}_abs": f"abs({column})"}, {f"{column}_mean": roll("avg", f"{column}_abs", _window(window))}], [column, f"{column}_mean"]


@indicator
def percentile(column: str, of: str = "atr_pct", window: int = 100, **parameters):
    """Per cent of the last `window` values of another indicator that are at most the current one."""
    n = _window(window)
    layers, outputs = INDICATORS[of](f"{column}_v", **parameters)
    v = outputs[0]
    frame = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return [*layers, {f"{column}_own": f"CASE WHEN count({v}) {frame} = {n} THEN gather({v}) {frame} END"}, {column: f"CASE WHEN {v} IS NOT NULL THEN 100.0 * length_of(kept_in({column}_own, v -> v <= {v})) / length_of({column}_own) END"}], [column]


# Volume.
@indicator
def obv(column: str):
    return [{f"{column}_signed": f"coalesce(sign(close - {lag('close')}), 0) * volume"}, {column: running(f"sum({column}_signed)")}], [column]


@indicator
def vwap(column: str, window: int = 20):
    n, c = _window(window), column
    return [{f"{c}_tpv": f"{TYPICAL} * volume"}, {c: over_zero(roll("sum", f"{c}_tpv", n, full=False), roll("sum", "volume", n, full=False))}], [c]


@indicator
def adl(column: str):
    return [{f"{column}_mfv": f"{MONEY_MULTIPLIER} * volume"}, {column: running(f"sum({column}_mfv)")}], [column]


@indicator
def cmf(column: str, window: int = 20):
    n, c = _window(window), column
    return [{f"{c}_mfv": f"{MONEY_MULTIPLIER} * volume"}, {c: over_zero(roll("sum", f"{c}_mfv", n), roll("sum", "volume", n))}], [c]


@indicator
def chaikin(column: str, fast: int = 3, slow: int = 10):
    f, s, c = _window(fast), _window(slow), column
    return [{f"{c}_mfv": f"{MONEY_MULTIPLIER} * volume"}, {f"{c}_adl": running(f"sum({c}_mfv)")}, {f"{c}_f": (f"{c}_adl", span(f), f), f"{c}_s": (f"{c}_adl", span(s), s)}, {c: f"{c}_f - {c}_s"}], [c]


@indicator
def force(column: str, window: int = 13):
    n, c = _window(window), column
    return [{f"{c}_raw": f"(close - {lag('close')}) * volume"}, {c: (f"{c}_raw", span(n), n)}], [c]


@indicator
def volume_ratio(column: str, window: int = 20):
    return [{column: over_zero("volume", roll("avg", "volume", _window(window)))}], [column]


@indicator
def volume_spike(column: str, window: int = 20, times: float = 2.0):
    c = column
    return [{f"{c}_base": roll("avg", "volume", _window(window), end=1)}, {c: f"CASE WHEN {c}_base IS NOT NULL THEN {flag(f'volume > {float(times)} * {c}_base')} END"}], [c]


@indicator
def pvt(column: str):
    return [{f"{column}_step": f"volume * coalesce({RETURN}, 0)"}, {column: running(f"sum({column}_step)")}], [column]


def _volume_index(column: str, falls: bool, start: float):
    """The index itself, not its logarithm: start times the product of the returns of bars whose volume falls (or rises)."""
    c = column
    return [
        {f"{c}_r": f"coalesce({RETURN}, 0)", f"{c}_dv": f"volume - {lag('volume')}"},
        {f"{c}_step": f"CASE WHEN {c}_dv {'<' if falls else '>'} 0 AND {c}_r > -1 THEN ln(1 + {c}_r) ELSE 0 END"},
        {f"{c}_total": running(f"sum({c}_step)")},
        {c: f"CASE WHEN {c}_dv IS NOT NULL THEN {float(start)} * exp({c}_total) END"},
    ], [c]


@indicator
def nvi(column: str, start: float = 1000.0):
    return _volume_index(column, True, start)


@indicator
def pvi(column: str, start: float = 1000.0):
    return _volume_index(column, False, start)


@indicator
def ease(column: str, window: int = 14):
    c = column
    return [{f"{c}_mid": "(high + low) / 2"}, {f"{c}_raw": over_zero(f"({c}_mid - {lag(f'{c}_mid')}) * (high - low)", "volume")}, {c: roll("avg", f"{c}_raw", _window(window))}], [c]


# Patterns and signals.
@indicator
def breakout(column: str, window: int = 20, volume_times: float | None = None):
    """1 above the highs of the bars before, -1 below their lows; with volume_times only on so much of their mean volume."""
    n, c = _window(window), column
    heavy = "" if volume_times is None else f" AND volume > {float(volume_times)} * {c}_base"
    return [{f"{c}_ph": roll("max", "high", n, 1), f"{c}_pl": roll("min", "low", n, 1), f"{c}_base": roll("avg", "volume", n, 1)}, {c: f"CASE WHEN {c}_ph IS NULL THEN NULL WHEN close > {c}_ph{heavy} THEN 1 WHEN close < {c}_pl{heavy} THEN -1 ELSE 0 END"}], [c]


@indicator
def range_position(column: str, window: int = 20):
    n, c = _window(window), column
    return [{f"{c}_hh": roll("max", "high", n), f"{c}_ll": roll("min", "low", n)}, {c: over_zero(f"close - {c}_ll", f"{c}_hh - {c}_ll")}], [c]


@indicator
def doji(column: str, body: float = 0.1):
    return [{column: f"CASE WHEN high > low THEN {flag(f'abs(close - open) <= {float(body)} * (high - low)')} END"}], [column]


@indicator
def engulfing(column: str):
    c, o = lag("close"), lag("open")
    return [{f"{column}_pc": c, f"{column}_po": o}, {column: f"CASE WHEN close > open AND {column}_pc < {column}_po AND close >= {column}_po AND open <= {column}_pc THEN 1 WHEN close < open AND {column}_pc > {column}_po AND open >= {column}_pc AND close <= {column}_po THEN -1 ELSE 0 END"}], [column]


@indicator
def trend_signal(column: str, fast: int = 20, slow: int = 50, least: float = 60.0):
    """Score 70 above a rising pair of averages, else 20; LONG where that reaches `least`."""
    c = column
    return [{f"{c}_f": roll("avg", "close", _window(fast)), f"{c}_s": roll("avg", "close", _window(slow))}, {f"{c}_score": f"CASE WHEN close > {c}_f AND {c}_f > {c}_s THEN 70 ELSE 20 END"}, {c: f"CASE WHEN {c}_score >= {float(least)} THEN 'LONG' ELSE 'FLAT' END"}], [f"{c}_score", c]


@indicator
def reversion_signal(column: str, window: int = 14, low: float = 30.0, high: float = 70.0):
    layers, (r,) = INDICATORS["rsi"](f"{column}_rsi", window=window)
    return [*layers, {column: f"CASE WHEN {r} < {float(low)} THEN 'LONG' WHEN {r} > {float(high)} THEN 'EXIT' ELSE 'FLAT' END"}], [column]


@indicator
def regime_score(column: str, window: int = 20):
    """0 to 100: 50 where the close is at its average, 100 at 20 % above."""
    return [{f"{column}_ma": roll("avg", "close", _window(window))}, {column: clip(f"50.0 + (close - {column}_ma) / nullif({column}_ma, 0) * 250.0", 0, 100)}], [column]


#: Other parameters than the defaults, in two requests of one shuffle each.
FAMILY_WINDOWS = {
    "wm": ("wma", {"window": 7}), "vw": ("vwma", {"window": 12}), "ar": ("aroon", {"window": 12}), "ich": ("ichimoku", {"conversion": 5, "base": 13, "leading": 30}), "sl": ("slope", {"window": 15}), "ms": ("ma_slope", {"window": 8, "bars": 3}),
    "mx": ("ma_cross", {"fast": 5, "slow": 17}), "am": ("above_ma", {"window": 9}), "mo": ("momentum", {"window": 3}), "wi": ("williams", {"window": 9}), "cc": ("cci", {"window": 8}), "mf": ("mfi", {"window": 6}), "ul": ("ultimate", {"short": 3, "middle": 6, "long": 12}),
    "ks": ("kst", {"spans": (3, 5, 7, 9), "means": (2, 3, 4, 5), "signal": 4}), "ap": ("atr_pct", {"window": 9}), "rp": ("range_pct", {"window": 9}), "gp": ("gap_pct", {"window": 9}), "vp": ("vwap", {"window": 9}), "cm": ("cmf", {"window": 9}), "vr": ("volume_ratio", {"window": 9}),
    "vs": ("volume_spike", {"window": 9, "times": 1.5}), "bo": ("breakout", {"window": 9, "volume_times": 1.1}), "po": ("range_position", {"window": 9}), "dj": ("doji", {"body": 0.3}), "en": ("engulfing", {}), "trend": ("trend_signal", {"fast": 5, "slow": 17}), "ob": ("obv", {}),
}


def f20_family_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request_in_one_pass(BARS.frame(spark, sf_dir), FAMILY_WINDOWS, 6)


QUERIES = {"f20_family_windows": f20_family_windows}


def _list_sql() -> str:
    """The same figures from lists of the last bars of each symbol, newest last."""
    last = lambda c, n: f"{c}[greatest(1, len({c}) - {n - 1}):]"
    full = lambda n, e: f"CASE WHEN i >= {n} THEN {e} END"
    mean = lambda c, n: f"list_avg({last(c, n)})"
    total = lambda c, n: f"list_sum({last(c, n)})"
    top, low = lambda n: f"list_max({last('hs', n)})", lambda n: f"list_min({last('ls', n)})"
    dot = lambda a, b, n: f"list_sum(list_transform(list_zip({last(a, n)}, {last(b, n)}), lambda z: z[1] * z[2]))"
    middle = lambda n: f"({top(n)} + {low(n)}) / 2"
    before = lambda c, k: f"{c}[len({c}) - {k}]"
    place = lambda c, v, n: f"(list_position({last(c, n)}, {v}) - 1) * 100.0 / {n - 1}"
    roc = lambda k, c="cs": f"({before(c, 0)} / nullif({before(c, k)}, 0) - 1)"
    return f"""WITH b AS ({BARS_SQL}),
p AS (SELECT *, (high + low + close) / 3 AS tp, lag(close) OVER s AS pc, lag(open) OVER s AS po, lag((high + low + close) / 3) OVER s AS ptp, row_number() OVER s AS i FROM b WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
x AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS mfv, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS pos, CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS neg, close - least(low, pc) AS bp, greatest(high, pc) - least(low, pc) AS utr, (high - low) / nullif(close, 0) AS rg, open / nullif(pc, 0) - 1 AS gap, sign(close - pc) * volume AS signed FROM p),
l AS (SELECT *, list(close) OVER w AS cs, list(high) OVER w AS hs, list(low) OVER w AS ls, list(volume) OVER w AS vs, list(tp) OVER w AS tps, list(tr) OVER w AS trs, list(mfv) OVER w AS ms, list(pos) OVER w AS ps, list(neg) OVER w AS ns, list(bp) OVER w AS bs, list(utr) OVER w AS us, list(rg) OVER w AS rgs, list(abs(gap)) OVER w AS gs, sum(signed) OVER (PARTITION BY symbol ORDER BY ts) AS ob0 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 39 PRECEDING)),
m AS (SELECT *, {mean('cs', 8)} AS ma8, {mean('cs', 9)} AS ma9, {mean('cs', 5)} AS f5, {mean('cs', 17)} AS s17, {full(8, mean('tps', 8))} AS t8, hs[greatest(1, len(hs) - 9):len(hs) - 1] AS h9, ls[greatest(1, len(ls) - 9):len(ls) - 1] AS l9, vs[greatest(1, len(vs) - 9):len(vs) - 1] AS v9,
  {" , ".join(f"CASE WHEN i > {n} THEN {roc(n)} * 100 END AS k{j}" for j, n in enumerate((3, 5, 7, 9)))} FROM l),
n AS (SELECT *, lag(ma8, 3) OVER s AS ma8_3, lag(f5) OVER s AS pf5, lag(s17) OVER s AS ps17, CASE WHEN close > ma9 THEN 1 WHEN close < ma9 THEN -1 ELSE 0 END AS side,
  {" , ".join(f"CASE WHEN i > {n + q - 1} THEN avg(k{j}) OVER (s ROWS {q - 1} PRECEDING) END AS n{j}" for j, (n, q) in enumerate(zip((3, 5, 7, 9), (2, 3, 4, 5), strict=True)))} FROM m WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
o AS (SELECT *, n0 + 2 * n1 + 3 * n2 + 4 * n3 AS kl, i - coalesce(max(CASE WHEN side <> before_side OR before_side IS NULL THEN i END) OVER (PARTITION BY symbol ORDER BY ts), 0) + 1 AS streak FROM (SELECT *, lag(side) OVER (PARTITION BY symbol ORDER BY ts) AS before_side FROM n) q),
r AS (SELECT *, CASE WHEN count(kl) OVER w = 4 THEN avg(kl) OVER w END AS ksig FROM o WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 3 PRECEDING)),
z AS (SELECT symbol, ts, (SELECT sum(v * k) / sum(k) FROM (SELECT unnest({last('cs', 7)}) AS v, generate_subscripts({last('cs', 7)}, 1) AS k)) AS wm, {full(12, dot('cs', 'vs', 12) + ' / nullif(' + total('vs', 12) + ', 0)')} AS vw,
  {full(13, place('hs', top(13), 13))} AS ar_up, {full(13, place('ls', low(13), 13))} AS ar_down, {middle(5)} AS ich_tenkan, {middle(13)} AS ich_kijun, ({middle(5)} + {middle(13)}) / 2 AS ich_a, {middle(30)} AS ich_b,
  {full(15, f"(SELECT regr_slope(v, k) / avg(v) FROM (SELECT unnest({last('cs', 15)}) AS v, generate_subscripts({last('cs', 15)}, 1) AS k))")} AS sl, (ma8 - ma8_3) / nullif(ma8, 0) AS ms, sign(f5 - s17) AS mx_state, CASE WHEN pf5 <= ps17 AND f5 > s17 THEN 1.0 WHEN pf5 >= ps17 AND f5 < s17 THEN -1.0 ELSE 0.0 END AS mx_event,
  CASE WHEN side = 1 THEN streak ELSE 0 END AS am_above, CASE WHEN side = -1 THEN streak ELSE 0 END AS am_below, CASE WHEN i > 3 THEN close - {before('cs', 3)} END AS mo, {full(9, f"-100 * ({top(9)} - close) / nullif({top(9)} - {low(9)}, 0)")} AS wi,
  (tp - t8) / nullif(0.015 * list_avg(list_transform({last('tps', 8)}, lambda v: abs(v - t8))), 0) AS cc, {full(6, f"CASE WHEN {total('ns', 6)} = 0 THEN 100 ELSE 100 * {total('ps', 6)} / ({total('ps', 6)} + {total('ns', 6)}) END")} AS mf,
  100 * (4 * {full(3, total('bs', 3) + ' / nullif(' + total('us', 3) + ', 0)')} + 2 * {full(6, total('bs', 6) + ' / nullif(' + total('us', 6) + ', 0)')} + {full(12, total('bs', 12) + ' / nullif(' + total('us', 12) + ', 0)')}) / 7 AS ul, kl AS ks_line, ksig AS ks_signal, kl - ksig AS ks_hist,
  {full(9, mean('trs', 9) + ' / nullif(close, 0)')} AS ap, rg AS rp, {full(9, mean('rgs', 9))} AS rp_mean, gap AS gp, CASE WHEN i >= 10 THEN {mean('gs', 9)} END AS gp_mean, {dot('tps', 'vs', 9)} / nullif({total('vs', 9)}, 0) AS vp, {full(9, total('ms', 9) + ' / nullif(' + total('vs', 9) + ', 0)')} AS cm, {full(9, 'volume / nullif(' + mean('vs', 9) + ', 0)')} AS vr,
  CASE WHEN i > 9 THEN CAST(volume > 1.5 * list_avg(v9) AS DOUBLE) END AS vs, CASE WHEN i > 9 THEN CASE WHEN close > list_max(h9) AND volume > 1.1 * list_avg(v9) THEN 1 WHEN close < list_min(l9) AND volume > 1.1 * list_avg(v9) THEN -1 ELSE 0 END END AS bo, {full(9, f"(close - {low(9)}) / nullif({top(9)} - {low(9)}, 0)")} AS po,
  CASE WHEN high > low THEN CAST(abs(close - open) <= 0.3 * (high - low) AS DOUBLE) END AS dj, CASE WHEN close > open AND pc < po AND close >= po AND open <= pc THEN 1 WHEN close < open AND pc > po AND open >= pc AND close <= po THEN -1 ELSE 0 END AS en, CASE WHEN i >= 17 AND close > f5 AND f5 > s17 THEN 70 ELSE 20 END AS trend_score, close, coalesce(ob0, 0) AS ob FROM r)
SELECT symbol, ts, {", ".join(f"round({c}, 6) AS {c}" for c in "wm vw ar_up ar_down ich_tenkan ich_kijun ich_a ich_b sl ms mx_state mx_event mo wi cc mf ul ks_line ks_signal ks_hist ap rp rp_mean gp gp_mean vp cm vr vs po dj ob".split())}, round(ar_up - ar_down, 6) AS ar_osc, CASE WHEN close > greatest(ich_a, ich_b) THEN 1 WHEN close < least(ich_a, ich_b) THEN -1 ELSE 0 END AS ich_cloud, am_above, am_below, bo, en, trend_score, CASE WHEN trend_score >= 60 THEN 'LONG' ELSE 'FLAT' END AS trend FROM z"""


ORACLES = {"f20_family_windows": _list_sql()}
