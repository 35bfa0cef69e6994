"""Indicators with parameters, requests of several and bundles.

An indicator is a function (column, **parameters) -> (layers, outputs), as the plans use them; `indicator` adds one's own.
A request merges the layers of all its indicators, so that they share one shuffle by symbol and one sort; recursive ones
are smoothed together in one more pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.indicators import TR
from barloom.operators.smoothed import span
from barloom.plans.arrays import over_symbols, supported
from barloom.plans.layers import Plan, Source, lag, over_zero, roll
from barloom.sources.bars import BARS, BARS_SQL

INDICATORS: dict[str, Callable] = {}


def indicator(function: Callable) -> Callable:
    """Registers function(column, **parameters) -> (layers, outputs) under its name."""
    INDICATORS[function.__name__] = function
    return function


def _window(n: int, least: int = 1) -> int:
    if int(n) != n or n < least:
        raise ValueError(f"a window of {n}: whole and {least} at least")
    return int(n)


@indicator
def sma(column: str, window: int = 20, of: str = "close"):
    return [{column: roll("avg", of, _window(window), full=False)}], [column]


@indicator
def ema(column: str, window: int = 20, of: str = "close"):
    return [{column: (of, span(_window(window)), 0)}], [column]


@indicator
def roc(column: str, window: int = 10):
    return [{column: f"(close / nullif({lag('close', _window(window))}, 0) - 1) * 100"}], [column]


@indicator
def volatility(column: str, window: int = 20):
    return [{f"{column}_r": f"close / nullif({lag('close')}, 0) - 1"}, {column: roll("stddev_samp", f"{column}_r", _window(window, 2))}], [column]


@indicator
def zscore(column: str, window: int = 20, of: str = "close"):
    n = _window(window, 2)
    return [{column: over_zero(f"{of} - {roll('avg', of, n)}", roll("stddev_samp", of, n))}], [column]


@indicator
def bands(column: str, window: int = 20, width: float = 2.0):
    """Bollinger bands."""
    n = _window(window)
    return [
        {f"{column}_mid": roll("avg", "close", n), f"{column}_sd": roll("stddev_pop", "close", n)},
        {f"{column}_upper": f"{column}_mid + {float(width)} * {column}_sd", f"{column}_lower": f"{column}_mid - {float(width)} * {column}_sd"},
    ], [f"{column}_mid", f"{column}_upper", f"{column}_lower"]


@indicator
def channel(column: str, window: int = 20):
    """Donchian channel of the bars before this one."""
    n = _window(window)
    return [{f"{column}_high": roll("max", "high", n, 1), f"{column}_low": roll("min", "low", n, 1)}], [f"{column}_high", f"{column}_low"]


@indicator
def stochastic(column: str, window: int = 14, smooth: int = 3):
    n = _window(window)
    return [
        {f"{column}_ll": roll("min", "low", n), f"{column}_hh": roll("max", "high", n)},
        {f"{column}_k": over_zero(f"100 * (close - {column}_ll)", f"{column}_hh - {column}_ll")},
        {f"{column}_d": roll("avg", f"{column}_k", _window(smooth))},
    ], [f"{column}_k", f"{column}_d"]


@indicator
def atr(column: str, window: int = 14):
    n = _window(window)
    return [{f"{column}_tr": TR}, {column: (f"{column}_tr", 1 / n, n)}], [column]


@indicator
def rsi(column: str, window: int = 14):
    n, move = _window(window), f"(close - {lag('close')})"
    return [
        {f"{column}_up": f"greatest({move}, 0 * {move})", f"{column}_down": f"greatest(-{move}, 0 * {move})"},
        {f"{column}_g": (f"{column}_up", 1 / n, n), f"{column}_l": (f"{column}_down", 1 / n, n)},
        {column: f"CASE WHEN {column}_l = 0 THEN CASE WHEN {column}_g > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + {column}_g / {column}_l) END"},
    ], [column]


@indicator
def ma_distance(column: str, kind: str = "sma", window: int = 20):
    """Per cent of the close above its average; kind is the name of an average."""
    layers, (average,) = INDICATORS[kind](f"{column}_ma", window=window)
    return [*layers, {column: over_zero(f"100 * (close - {average})", average)}], [column]


#: Bundles: column -> (indicator, parameters).
BUNDLES = {
    "trend": {"sma_20": ("sma", {}), "sma_50": ("sma", {"window": 50}), "ema_20": ("ema", {}), "distance_50": ("ma_distance", {"window": 50}), "channel_20": ("channel", {})},
    "momentum": {"roc_10": ("roc", {}), "rsi_14": ("rsi", {}), "stoch_14": ("stochastic", {})},
    "volatility": {"vol_20": ("volatility", {}), "atr_14": ("atr", {}), "bands_20": ("bands", {})},
}


def _merged(parts: list[list[dict]]) -> list[dict]:
    """All plain layers that are due in one, then all recursive ones that are due in one, until none is left."""
    parts, out = [list(p) for p in parts if p], []
    recursive = lambda layer: isinstance(next(iter(layer.values())), tuple)
    while parts:
        due = [p for p in parts if not recursive(p[0])] or parts
        out.append({c: e for p in due for c, e in p.pop(0).items()})
        parts = [p for p in parts if p]
    return out


def request_plan(source: Source, wanted: dict[str, tuple[str, dict]]) -> Plan:
    """wanted: column -> (indicator, parameters). Columns must be new and distinct."""
    for name, _ in wanted.values():
        if name not in INDICATORS:
            raise KeyError(f"no indicator {name}: one of {', '.join(sorted(INDICATORS))}")
    made = [INDICATORS[name](column, **parameters) for column, (name, parameters) in wanted.items()]
    return Plan(source, tuple(_merged([layers for layers, _ in made]))).returning("symbol", "ts", *(c for _, outputs in made for c in outputs))


def request(bars: DataFrame, wanted: dict[str, tuple[str, dict]]) -> DataFrame:
    """bars(symbol, ts, open, high, low, close, volume) -> symbol, ts and the columns of the indicators. Series shorter
    than a window give null (averages: the mean so far); an empty table gives an empty one; other columns are not read."""
    return request_plan(Source(lambda spark, sf_dir: bars, ""), wanted).frame(bars.sparkSession, "")


def request_in_one_pass(bars: DataFrame, wanted: dict[str, tuple[str, dict]], digits: int) -> DataFrame:
    """The same, doubles rounded to `digits`: by one pass over arrays instead of a window operator for each layer, where all
    layers can be worked out so."""
    plan, found = request_plan(Source(lambda spark, sf_dir: bars, ""), wanted), request(bars, wanted)
    kinds = dict(found.dtypes)
    if supported(plan.layers) and set(kinds.values()) <= {"double", "int", "bigint", "string", kinds["symbol"], kinds["ts"]}:
        return over_symbols(bars, plan.layers, plan.out, kinds, digits)
    return found.selectExpr(*(f"round({c}, {digits}) AS {c}" if k == "double" else c for c, k in kinds.items()))


WINDOWS = {
    "fast": ("sma", {"window": 10}), "slow": ("sma", {"window": 50}), "wide": ("bands", {"window": 30, "width": 1.5}), "roc_5": ("roc", {"window": 5}), "z": ("zscore", {"window": 30}),
    "turn": ("channel", {"window": 40}), "gap": ("ma_distance", {"window": 50}), "vol": ("volatility", {"window": 60}), "k": ("stochastic", {"window": 21, "smooth": 5}),
}
AVERAGES = {"e5": ("ema", {"window": 5}), "e50": ("ema", {"window": 50}), "off": ("ma_distance", {"kind": "ema", "window": 10}), "rsi_7": ("rsi", {"window": 7}), "atr_21": ("atr", {"window": 21})}


def f20_request_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request(BARS.frame(spark, sf_dir), WINDOWS)


def f20_request_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request(BARS.frame(spark, sf_dir), AVERAGES)


def f20_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return request(BARS.frame(spark, sf_dir), BUNDLES["trend"] | BUNDLES["volatility"])


_SQL_WINDOWS = f"""WITH b AS ({BARS_SQL}), q AS (SELECT *, close / lag(close) OVER s - 1 AS r, list(close) OVER w30 AS c30, list(high) OVER h40 AS hs, list(low) OVER h40 AS ls, list(low) OVER w21 AS l21, list(high) OVER w21 AS h21, list(close) OVER w50 AS c50 FROM b
  WINDOW s AS (PARTITION BY symbol ORDER BY ts), w21 AS (PARTITION BY symbol ORDER BY ts ROWS 20 PRECEDING), w30 AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING), h40 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, list(r) FILTER (r IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING) AS r60, CASE WHEN len(l21) = 21 AND list_max(h21) > list_min(l21) THEN 100 * (close - list_min(l21)) / (list_max(h21) - list_min(l21)) END AS k_k FROM q),
u AS (SELECT *, list(k_k) FILTER (k_k IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) AS k5 FROM v)
SELECT symbol, ts, list_avg(c50[greatest(1, len(c50) - 9):]) AS fast, list_avg(c50) AS slow, CASE WHEN len(c30) = 30 THEN list_avg(c30) END AS wide_mid, CASE WHEN len(c30) = 30 THEN list_avg(c30) + 1.5 * list_stddev_pop(c30) END AS wide_upper, CASE WHEN len(c30) = 30 THEN list_avg(c30) - 1.5 * list_stddev_pop(c30) END AS wide_lower,
  CASE WHEN len(c50) > 5 THEN 100 * (close - c50[len(c50) - 5]) / c50[len(c50) - 5] END AS roc_5, CASE WHEN len(c30) = 30 THEN (close - list_avg(c30)) / nullif(list_stddev_samp(c30), 0) END AS z, CASE WHEN len(hs) = 40 THEN list_max(hs) END AS turn_high, CASE WHEN len(ls) = 40 THEN list_min(ls) END AS turn_low,
  100 * (close / list_avg(c50) - 1) AS gap, CASE WHEN len(r60) = 60 THEN list_stddev_samp(r60) END AS vol, k_k, CASE WHEN len(k5) = 5 THEN list_avg(k5) END AS k_d FROM u"""
_SQL_AVERAGES = f"""WITH b AS ({BARS_SQL}), q AS (SELECT *, list(close) OVER s AS cs, row_number() OVER s AS i, close - lag(close) OVER s AS d, greatest(high - low, coalesce(abs(high - lag(close) OVER s), 0), coalesce(abs(low - lag(close) OVER s), 0)) AS tr FROM b WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
v AS (SELECT *, list(tr) OVER s AS trs, list(greatest(d, 0)) FILTER (d IS NOT NULL) OVER s AS ups, list(greatest(-d, 0)) FILTER (d IS NOT NULL) OVER s AS downs FROM q WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
w AS (SELECT *, list_reduce(ups, lambda a, x: a * 6 / 7 + x / 7) AS g, list_reduce(downs, lambda a, x: a * 6 / 7 + x / 7) AS l, list_reduce(cs, lambda a, x: a * 9 / 11 + x * 2 / 11) AS e10 FROM v)
SELECT symbol, ts, list_reduce(cs, lambda a, x: a * 2 / 3 + x / 3) AS e5, list_reduce(cs, lambda a, x: a * 49 / 51 + x * 2 / 51) AS e50, 100 * (close / e10 - 1) AS off, CASE WHEN i > 7 THEN CASE WHEN l = 0 AND g = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 * g / (g + l) END END AS rsi_7, CASE WHEN i >= 21 THEN list_reduce(trs, lambda a, x: a * 20 / 21 + x / 21) END AS atr_21 FROM w"""

QUERIES = {f.__name__: f for f in (f20_request_windows, f20_request_averages, f20_bundles)}
ORACLES = {"f20_request_windows": _SQL_WINDOWS, "f20_request_averages": _SQL_AVERAGES, "f20_bundles": request_plan(BARS, BUNDLES["trend"] | BUNDLES["volatility"]).sql()}
