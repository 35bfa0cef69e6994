"""Indicators with parameters: the defaults are the named queries, other values follow pandas."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest

from barloom.functions import families  # noqa: F401  registers
from barloom.functions.indicators import INDICATORS, request
from barloom.plans import registry
from barloom.sources.bars import BARS

from .conftest import SMALL

#: Query -> (indicator, parameters, {query's column: the request's column of x}).
DEFAULTS = {
    "wn03_wma": ("wma", {}, {"wma": "x"}), "wn09_macd": ("macd", {}, {"macd": "x_line", "macd_signal": "x_signal", "macd_hist": "x_hist"}), "wn11_obv": ("obv", {}, {"obv": "x"}), "wn12_vwap": ("vwap", {}, {"vwap": "x"}),
    "wt02_ma_cross_state": ("ma_cross", {}, {"ma_cross_state_sma_20_50": "x_state"}), "wt03_ma_cross_event": ("ma_cross", {}, {"ma_cross_event_sma_20_50": "x_event"}), "wt04_ma_slope": ("ma_slope", {}, {"ma_slope_sma_20_5": "x"}),
    "wt06_bars_above_below_ma": ("above_ma", {}, {"bars_above_sma_20": "x_above", "bars_below_sma_20": "x_below"}), "wt08_keltner": ("keltner", {}, {"keltner_mid_20": "x_mid", "keltner_upper": "x_upper", "keltner_lower": "x_lower"}),
    "wt09_adx": ("adx", {}, {"adx_14": "x", "plus_di_14": "x_plus", "minus_di_14": "x_minus"}), "wt10_aroon": ("aroon", {}, {"aroon_up_25": "x_up", "aroon_down_25": "x_down", "aroon_osc_25": "x_osc"}),
    "wt11_ichimoku": ("ichimoku", {}, {"ichimoku_tenkan_9": "x_tenkan", "ichimoku_senkou_b_raw": "x_b", "ichimoku_cloud_state": "x_cloud"}), "wt13_linreg_slope": ("slope", {}, {"linreg_slope_20": "x"}), "wm01_momentum": ("momentum", {}, {"momentum": "x"}),
    "wm05_williams_r": ("williams", {}, {"williams_r": "x"}), "wm06_cci": ("cci", {}, {"cci": "x"}), "wm07_mfi": ("mfi", {}, {"mfi": "x"}), "wm08_tsi": ("tsi", {}, {"tsi": "x_line", "tsi_signal": "x_signal"}), "wm09_ultimate_osc": ("ultimate", {}, {"ultimate_osc": "x"}),
    "wm10_ppo": ("ppo", {}, {"ppo": "x_line", "ppo_hist": "x_hist"}), "wm11_kst": ("kst", {}, {"kst": "x_line", "kst_signal": "x_signal"}), "wv01_atr_pct": ("atr_pct", {}, {"atr_pct": "x"}), "wv03_historical_volatility": ("historical", {}, {"hist_vol": "x"}),
    "wv04_realized_volatility": ("realized", {}, {"realized_vol": "x"}), "wv05_parkinson_volatility": ("parkinson", {}, {"parkinson_vol": "x"}), "wv06_garman_klass_volatility": ("garman_klass", {}, {"garman_klass_vol": "x"}), "wv07_rogers_satchell_volatility": ("rogers_satchell", {}, {"rogers_satchell_vol": "x"}),
    "wv08_range_percent": ("range_pct", {}, {"range_pct": "x", "range_pct_ma": "x_mean"}), "wv09_gap_percent": ("gap_pct", {}, {"gap_pct": "x", "gap_pct_ma": "x_mean"}), "wv11_atr_percentile": ("percentile", {}, {"atr_pct_percentile": "x"}), "wq03_volume_ratio": ("volume_ratio", {}, {"volume_ratio": "x"}),
    "wq06_volume_spike": ("volume_spike", {}, {"volume_spike": "x"}), "wq08_vwma": ("vwma", {}, {"vwma": "x"}), "wq10_adl": ("adl", {}, {"adl": "x"}), "wq11_cmf": ("cmf", {}, {"cmf": "x"}), "wq12_chaikin_osc": ("chaikin", {}, {"chaikin_osc": "x"}), "wq13_pvt": ("pvt", {}, {"pvt": "x"}),
    "wq14_force_index": ("force", {}, {"force_index_ema": "x"}), "g01_moving_average_trend": ("trend_signal", {}, {"score": "x_score"}), "wp04_range_position": ("range_position", {}, {}),
}


def test_defaults_are_the_named_queries(spark):
    """All in one request: one shuffle for 39 families."""
    bars = BARS.frame(spark, SMALL).where("symbol < 2")
    wanted = {q: (name, parameters) for q, (name, parameters, _) in DEFAULTS.items()}
    got = request(bars, wanted).toPandas().set_index(["symbol", "ts"]).sort_index()
    with ThreadPoolExecutor(6) as pool:  # most of a query's time is the driver's
        named = dict(zip(DEFAULTS, pool.map(lambda q: registry.QUERIES[q](spark, SMALL).where("symbol < 2").toPandas(), DEFAULTS), strict=True))
    for q, (_, _, columns) in DEFAULTS.items():
        if columns:
            want = named[q].set_index(["symbol", "ts"]).sort_index()
            for theirs, own in columns.items():
                a, b = want[theirs].astype(float).to_numpy(), got[q + own[1:]].astype(float).to_numpy()
                assert np.allclose(a, b, rtol=1e-6, atol=1e-5, equal_nan=True), (q, theirs)


@pytest.fixture(scope="module")
def walk():
    draw = np.random.default_rng(8)
    close = 100 + np.cumsum(draw.normal(0, 1, 200))
    open_ = close + draw.normal(0, 0.5, 200)
    return pd.DataFrame({"symbol": 1, "ts": pd.date_range("2024-01-01", periods=200).date, "open": open_, "high": np.maximum(open_, close) + draw.random(200), "low": np.minimum(open_, close) - draw.random(200), "close": close, "volume": draw.integers(1, 100, 200).astype(float)})


def test_other_parameters_follow_pandas(spark, walk):
    f = walk
    ewm = lambda s, n: s.ewm(span=n, adjust=False).mean()
    line = ewm(f.close, 5) - ewm(f.close, 11)
    growth = f.close.pct_change().fillna(0)
    falls = f.volume.diff() < 0
    want = {
        "macd_line": line, "macd_signal": ewm(line, 4), "keltner_mid": ewm(f.close, 7), "nvi": (50 * (1 + growth.where(falls, 0)).cumprod()).where(f.volume.diff().notna()), "pvi": (1000 * (1 + growth.where(f.volume.diff() > 0, 0)).cumprod()).where(f.volume.diff().notna()),
        "force": ((f.close.diff() * f.volume).ewm(span=6, adjust=False, min_periods=6).mean()), "ease": (((f.high + f.low) / 2).diff() * (f.high - f.low) / f.volume).rolling(5).mean(), "historical": np.log(f.close).diff().rolling(9).std() * np.sqrt(365),
        "parkinson": np.sqrt((np.log(f.high / f.low) ** 2).rolling(9).mean() * 252 / (4 * np.log(2))), "score": (50 + (f.close / f.close.rolling(9).mean() - 1) * 250).clip(0, 100), "rank": f.close.rolling(9).std().rolling(30).apply(lambda v: (v <= v.iloc[-1]).mean() * 100),
    }
    wanted = {
        "macd": ("macd", {"fast": 5, "slow": 11, "signal": 4}), "keltner": ("keltner", {"window": 7, "width": 1.0}), "nvi": ("nvi", {"start": 50}), "pvi": ("pvi", {}), "force": ("force", {"window": 6}), "ease": ("ease", {"window": 5}),
        "historical": ("historical", {"window": 9, "year": 365}), "parkinson": ("parkinson", {"window": 9}), "score": ("regime_score", {"window": 9}),
    }
    got = request(spark.createDataFrame(f), wanted).toPandas().sort_values("ts")
    for c, series in want.items():
        if c != "rank":
            assert np.allclose(series.to_numpy(float), got[c].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_requests_are_refused(spark, walk):
    df = spark.createDataFrame(walk)
    assert len(INDICATORS) > 55
    for name, parameters in (("macd", {"fast": 9, "slow": 5}), ("kst", {"spans": (1, 2)}), ("cci", {"window": 0}), ("wma", {"window": 2.5})):
        with pytest.raises(ValueError):
            request(df, {"x": (name, parameters)})
    with pytest.raises(TypeError):
        request(df, {"x": ("obv", {"window": 3})})
