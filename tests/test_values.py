"""Indicators on a random walk against pandas, written from their definitions and not from the queries' text."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom.operators.indicators import INDICATORS
from barloom.operators.smoothed import SMOOTHED
from barloom.plans.layers import Plan, Source

N = 160
BARS = "symbol long, ts date, open double, high double, low double, close double, volume double"


def walk(symbol: int) -> pd.DataFrame:
    draw = np.random.default_rng(symbol)
    close = 100 * np.exp(np.cumsum(draw.normal(0, 0.02, N)))
    open_ = close * np.exp(draw.normal(0, 0.01, N))
    high, low = np.maximum(open_, close) * (1 + draw.uniform(0, 0.02, N)), np.minimum(open_, close) * (1 - draw.uniform(0, 0.02, N))
    flat = np.arange(N) % 40 == 39
    open_, high, low = (np.where(flat, close, x) for x in (open_, high, low))
    return pd.DataFrame({"symbol": symbol, "ts": [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(N)], "open": open_, "high": high, "low": low, "close": close, "volume": draw.integers(100, 5000, N).astype(float)})


def ema(x, span, least=0):
    return x.ewm(span=span, adjust=False, min_periods=least).mean()


def wilder(x, n, least=0):
    return x.ewm(alpha=1 / n, adjust=False, min_periods=least).mean()


def rsi(x, n, least=0):
    move = x.diff()
    up, down = wilder(move.clip(lower=0), n, least), wilder(-move.clip(upper=0), n, least)
    return (100 * up / (up + down)).where(up + down != 0, 50.0).where(up.notna())


def true_range(b):
    return pd.concat([b.high - b.low, (b.high - b.close.shift()).abs(), (b.low - b.close.shift()).abs()], axis=1).max(axis=1)


def ratio(a, b):
    return (a / b.where(b != 0)).astype(float)


def zscore(x, n):
    return ratio(x - x.rolling(n).mean(), x.rolling(n).std())


def money_flow(b):
    return ratio((b.close - b.low) - (b.high - b.close), b.high - b.low).fillna(0) * b.volume


def stoch(b):
    low, high = b.low.rolling(14).min(), b.high.rolling(14).max()
    k = 100 * ratio(b.close - low, high - low)
    return k, k.rolling(3).mean()


def obv(b):
    return (np.sign(b.close.diff().fillna(0)) * b.volume).cumsum()


def mfi(b):
    typical = (b.high + b.low + b.close) / 3
    flow, move = typical * b.volume, typical.diff()
    up, down = flow.where(move > 0, 0.0).rolling(14).sum(), flow.where(move < 0, 0.0).rolling(14).sum()
    return 100 - 100 / (1 + up / down)


def ultimate(b):
    floor = np.fmin(b.low, b.close.shift())
    pressure, span = b.close - floor, np.fmax(b.high, b.close.shift()) - floor
    part = [pressure.rolling(n).sum() / span.rolling(n).sum() for n in (7, 14, 28)]
    return 100 * (4 * part[0] + 2 * part[1] + part[2]) / 7


def kst(b):
    return sum(w * (100 * b.close.pct_change(r)).rolling(n).mean() for w, r, n in ((1, 10, 10), (2, 15, 10), (3, 20, 10), (4, 30, 15)))


def tsi(b):
    move = b.close.diff()
    return 100 * ema(ema(move, 25), 13) / ema(ema(move.abs(), 25), 13)


def directions(b):
    up, down = b.high.diff(), -b.low.diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    tr = wilder(true_range(b), 14)
    plus, minus = 100 * wilder(plus, 14) / tr, 100 * wilder(minus, 14) / tr
    return plus, minus, wilder(100 * ratio((plus - minus).abs(), plus + minus), 14)


def middle(b, n):
    return (b.high.rolling(n, min_periods=1).max() + b.low.rolling(n, min_periods=1).min()) / 2


def runs(b, above):
    """Length of the unbroken run of bars on one side of the average, counted bar by bar."""
    out, k = [], 0
    for c, m in zip(b.close, b.close.rolling(20, min_periods=1).mean(), strict=True):
        k = k + 1 if (c > m if above else c < m) else 0
        out.append(k)
    return pd.Series(out, dtype=float)


def squared(b, n):
    return np.sqrt(n.rolling(20).mean().clip(lower=0) * 252)


def place(b, column, best):
    return column.rolling(26).apply(lambda x: 100 * best(x) / 25, raw=True)


def by_row(b, step, start=1000.0):
    """Logarithm of an index that moves on some bars only, multiplied bar by bar."""
    out, level = [np.nan], start
    for i in range(1, len(b)):
        if step(b.volume[i], b.volume[i - 1]):
            level *= b.close[i] / b.close[i - 1]
        out.append(np.log(level))
    return pd.Series(out)


LOG = {"up": lambda b: np.log(b.close / b.close.shift()), "hl": lambda b: np.log(b.high / b.low), "co": lambda b: np.log(b.close / b.open)}
SMA = lambda b, n: b.close.rolling(n, min_periods=1).mean()
FAST_SLOW = lambda b: ema(b.close, 12) - ema(b.close, 26)
TYPICAL = lambda b: (b.high + b.low + b.close) / 3
PPO = lambda b: 100 * FAST_SLOW(b) / ema(b.close, 26)

#: query: {column: its value by pandas}
WANT = {
    "wn01_sma": {"sma": lambda b: SMA(b, 20)},
    "wn02_ema": {"ema": lambda b: ema(b.close, 20)},
    "wn03_wma": {"wma": lambda b: b.close.rolling(20, min_periods=1).apply(lambda x: np.average(x, weights=range(1, len(x) + 1)), raw=True)},
    "wn04_rsi": {"rsi": lambda b: rsi(b.close, 14, 14)},
    "wn05_roc": {"roc": lambda b: 100 * b.close.pct_change(10)},
    "wn06_tr": {"tr": true_range},
    "wn07_atr": {"atr": lambda b: wilder(true_range(b), 14, 14)},
    "wn08_bb": {"bb_mid": lambda b: b.close.rolling(20).mean(), "bb_upper": lambda b: b.close.rolling(20).mean() + 2 * b.close.rolling(20).std(ddof=0), "bb_width": lambda b: 4 * b.close.rolling(20).std(ddof=0) / b.close.rolling(20).mean()},
    "wn09_macd": {"macd": FAST_SLOW, "macd_signal": lambda b: ema(FAST_SLOW(b), 9), "macd_hist": lambda b: FAST_SLOW(b) - ema(FAST_SLOW(b), 9)},
    "wn10_stoch": {"stoch_k": lambda b: stoch(b)[0], "stoch_d": lambda b: stoch(b)[1]},
    "wn11_obv": {"obv": obv},
    "wn13_return": {"ret": lambda b: b.close.pct_change()},
    "wn14_log_return": {"log_return": LOG["up"]},
    "wn15_volatility": {"volatility": lambda b: b.close.pct_change().rolling(20).std()},
    "wt01_ma_distance": {"ma_distance_sma_20": lambda b: b.close / SMA(b, 20) - 1},
    "wt02_ma_cross_state": {"ma_cross_state_sma_20_50": lambda b: np.sign(SMA(b, 20) - SMA(b, 50))},
    "wt04_ma_slope": {"ma_slope_sma_20_5": lambda b: SMA(b, 20).diff(5) / SMA(b, 20)},
    "wt05_price_above_ma": {"price_above_sma_20": lambda b: (b.close > SMA(b, 20)).astype(float)},
    "wt06_bars_above_below_ma": {"bars_above_sma_20": lambda b: runs(b, True), "bars_below_sma_20": lambda b: runs(b, False)},
    "wt07_donchian": {"donchian_high_20": lambda b: b.high.rolling(20, min_periods=1).max(), "donchian_low_20": lambda b: b.low.rolling(20, min_periods=1).min()},
    "wt08_keltner": {"keltner_mid_20": lambda b: ema(b.close, 20), "keltner_upper": lambda b: ema(b.close, 20) + 2 * wilder(true_range(b), 14), "keltner_lower": lambda b: ema(b.close, 20) - 2 * wilder(true_range(b), 14)},
    "wt09_adx": {"plus_di_14": lambda b: directions(b)[0], "minus_di_14": lambda b: directions(b)[1], "adx_14": lambda b: directions(b)[2]},
    "wt10_aroon": {"aroon_up_25": lambda b: place(b, b.high, np.argmax), "aroon_down_25": lambda b: place(b, b.low, np.argmin)},
    "wt11_ichimoku": {"ichimoku_tenkan_9": lambda b: middle(b, 9), "ichimoku_kijun_26": lambda b: middle(b, 26), "ichimoku_senkou_a_raw": lambda b: (middle(b, 9) + middle(b, 26)) / 2, "ichimoku_senkou_b_raw": lambda b: middle(b, 52)},
    "wt13_linreg_slope": {"linreg_slope_20": lambda b: b.close.rolling(20).apply(lambda x: np.polyfit(range(20), x, 1)[0] / x.mean(), raw=True)},
    "wm01_momentum": {"momentum": lambda b: b.close.diff(10)},
    "wm02_roc_pct": {"roc_pct": lambda b: b.close.pct_change(10)},
    "wm03_rsi_enhanced": {"rsi": lambda b: rsi(b.close, 14), "rsi_slope": lambda b: rsi(b.close, 14).diff(3)},
    "wm04_stoch_enhanced": {"stoch_k": lambda b: stoch(b)[0], "stoch_d": lambda b: stoch(b)[1]},
    "wm05_williams_r": {"williams_r": lambda b: stoch(b)[0] - 100},
    "wm06_cci": {"cci": lambda b: (TYPICAL(b) - TYPICAL(b).rolling(20).mean()) / (0.015 * TYPICAL(b).rolling(20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True))},
    "wm07_mfi": {"mfi": mfi},
    "wm08_tsi": {"tsi": tsi, "tsi_signal": lambda b: ema(tsi(b), 7)},
    "wm09_ultimate_osc": {"ultimate_osc": ultimate},
    "wm10_ppo": {"ppo": PPO, "ppo_signal": lambda b: ema(PPO(b), 9)},
    "wm11_kst": {"kst": kst, "kst_signal": lambda b: kst(b).rolling(9).mean()},
    "wv01_atr_pct": {"atr_pct": lambda b: true_range(b).rolling(14).mean() / b.close},
    "wv02_normalized_true_range": {"ntr": lambda b: true_range(b) / b.close, "ntr_ma": lambda b: (true_range(b) / b.close).rolling(14).mean()},
    "wv03_historical_volatility": {"hist_vol": lambda b: LOG["up"](b).rolling(20).std() * np.sqrt(252)},
    "wv05_parkinson_volatility": {"parkinson_vol": lambda b: np.sqrt((LOG["hl"](b) ** 2).rolling(20).mean() * 252 / (4 * np.log(2)))},
    "wv06_garman_klass_volatility": {"garman_klass_vol": lambda b: squared(b, 0.5 * LOG["hl"](b) ** 2 - (2 * np.log(2) - 1) * LOG["co"](b) ** 2)},
    "wv07_rogers_satchell_volatility": {"rogers_satchell_vol": lambda b: squared(b, np.log(b.high / b.close) * np.log(b.high / b.open) + np.log(b.low / b.close) * np.log(b.low / b.open))},
    "wv08_range_percent": {"range_pct": lambda b: (b.high - b.low) / b.close, "range_pct_zscore": lambda b: zscore((b.high - b.low) / b.close, 20)},
    "wv09_gap_percent": {"gap_pct": lambda b: b.open / b.close.shift() - 1, "gap_pct_zscore": lambda b: zscore((b.open / b.close.shift() - 1).abs(), 20)},
    "wq01_volume_sma": {"volume_sma": lambda b: b.volume.rolling(20).mean()},
    "wq02_volume_ema": {"volume_ema": lambda b: ema(b.volume, 20, 20)},
    "wq03_volume_ratio": {"volume_ratio": lambda b: b.volume / b.volume.rolling(20).mean()},
    "wq04_volume_roc": {"volume_roc": lambda b: b.volume.pct_change(10)},
    "wq05_volume_zscore": {"volume_zscore": lambda b: zscore(b.volume, 20)},
    "wq06_volume_spike": {"volume_spike_ratio": lambda b: b.volume / b.volume.rolling(20).mean().shift()},
    "wq07_turnover": {"turnover_try": lambda b: b.close * b.volume, "turnover_try_sma": lambda b: (b.close * b.volume).rolling(20, min_periods=1).mean()},
    "wq08_vwma": {"vwma": lambda b: (b.close * b.volume).rolling(20).sum() / b.volume.rolling(20).sum()},
    "wq10_adl": {"adl": lambda b: money_flow(b).cumsum()},
    "wq11_cmf": {"cmf": lambda b: money_flow(b).rolling(20).sum() / b.volume.rolling(20).sum()},
    "wq12_chaikin_osc": {"chaikin_osc": lambda b: ema(money_flow(b).cumsum(), 3, 3) - ema(money_flow(b).cumsum(), 10, 10)},
    "wq14_force_index": {"force_index": lambda b: b.close.diff() * b.volume, "force_index_ema": lambda b: ema(b.close.diff() * b.volume, 13, 13)},
    "wq16_nvi": {"log_nvi": lambda b: by_row(b, lambda new, old: new < old)},
    "wq17_pvi": {"log_pvi": lambda b: by_row(b, lambda new, old: new > old)},
    "wq19_vwap_enhanced": {"vwap": lambda b: (TYPICAL(b) * b.volume).rolling(20).sum() / b.volume.rolling(20).sum()},
    "wq20_obv_enhanced": {"obv": obv, "obv_slope": lambda b: obv(b).diff(5)},
}


@pytest.fixture(scope="module")
def market(spark):
    frames = {s: walk(s) for s in (1, 2)}
    return frames, spark.createDataFrame(pd.concat(frames.values()), BARS).repartition(3).cache()


@pytest.mark.parametrize("name", sorted(WANT))
def test_values(spark, market, name):
    frames, df = market
    layers, out = (INDICATORS | SMOOTHED)[name]
    got = Plan(Source(lambda s, d: df, ""), tuple(layers)).returning("symbol", "ts", *out).frame(spark, "").toPandas().sort_values("ts")
    for symbol, own in frames.items():
        mine = got[got.symbol == symbol]
        for column, formula in WANT[name].items():
            a, b = mine[column].astype(float).to_numpy(), formula(own).astype(float).to_numpy()
            assert (np.isfinite(b)).sum() > N / 3, column
            np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9, err_msg=f"{column} of {symbol}")
