"""Cross-sections, breadth, factors, valuation, quality reports: statements over the research tables."""

from __future__ import annotations

from barloom.plans.statements import Statement, table
from barloom.sources import tables as t
from barloom.sources.bars import BARS

S = {
    "bars": BARS, "instruments": t.INSTRUMENTS, "breadth": t.BREADTH, "returns": t.RETURNS, "market": t.INDEX, "trades": t.TRADES, "outcomes": t.OUTCOMES, "statements": t.STATEMENTS,
    "positions": t.POSITIONS, "events": t.EVENTS, **{n: table(n) for n in ("lineitem", "orders", "customer", "part", "supplier", "nation", "region", "documents", "labels", "embeddings", "conversations", "benchmark")},
}

_COUNTS = "count_if(close > previous_close) AS advances, count_if(close < previous_close) AS declines, count_if(close = previous_close) AS unchanged"
_ADVANCE = f"SELECT ts, {_COUNTS} FROM {{breadth}} WHERE previous_close IS NOT NULL GROUP BY ts"
_RATIO = "CASE WHEN declines = 0 THEN CASE WHEN advances > 0 THEN CAST(advances AS DOUBLE) ELSE 1.0 END ELSE advances / declines END"
_ABOVE = ", ".join(f"100 * avg(CASE WHEN ma_{n} IS NOT NULL THEN CASE WHEN close > ma_{n} THEN 1.0 ELSE 0.0 END END) AS above_{n}" for n in (20, 50, 100, 200))
_PARTICIPATION = f"SELECT ts, {_ABOVE}, 100 * avg(CASE WHEN close > previous_close THEN 1.0 ELSE 0.0 END) AS positive_pct FROM {{breadth}} WHERE previous_close IS NOT NULL GROUP BY ts"
_RS = "SELECT symbol, sector, ts, " + ", ".join(f"close / nullif(close_{n}_ago, 0) - 1 AS m{n}" for n in (20, 50, 100)) + " FROM {breadth}"
_FACTORS = "SELECT symbol, sector, ts, close / nullif(close_20_ago, 0) - 1 AS momentum, -(high - low) / nullif(close, 0) AS low_range, volume FROM {breadth}"
_MULTIPLES = "SELECT symbol, period, fiscal_year, revenue, profit, debt, cap, cap / nullif(profit, 0) AS pe, (cap + debt) / nullif(revenue, 0) AS ev_sales, profit / cap AS earnings_yield FROM (SELECT *, revenue / n_orders * (3 + symbol % 7) + 5000 AS cap FROM {statements}) c"

TEXTS = {
    "a01_advance_decline": f"SELECT ts, advances, declines, unchanged, advances - declines AS net, round({_RATIO}, 6) AS ratio, CASE WHEN {_RATIO} >= 2.0 THEN 'STRONG' WHEN {_RATIO} >= 1.2 THEN 'POSITIVE' WHEN {_RATIO} > 0.8 THEN 'NEUTRAL' WHEN {_RATIO} > 0.5 THEN 'NEGATIVE' ELSE 'WEAK' END AS class FROM ({_ADVANCE}) q",
    "a02_percent_above_ma": f"SELECT ts, {', '.join(f'round(above_{n}, 6) AS above_{n}' for n in (20, 50, 100, 200))} FROM ({_PARTICIPATION}) q",
    "a03_new_highs_lows": "SELECT ts, count_if(high >= high_20d) AS highs_20, count_if(low <= low_20d) AS lows_20, count_if(close >= high_252d) AS closes_high_252, count_if(close <= low_252d) AS closes_low_252 FROM {breadth} GROUP BY ts",
    "a04_volume_breadth": "SELECT ts, up_volume, down_volume, round(up_volume / nullif(down_volume, 0), 6) AS ratio FROM (SELECT ts, sum(CASE WHEN close > previous_close THEN volume ELSE 0 END) AS up_volume, sum(CASE WHEN close < previous_close THEN volume ELSE 0 END) AS down_volume FROM {breadth} GROUP BY ts) q",
    "a05_momentum_breadth": "SELECT ts, round(100 * avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_pct, round(100 * avg(CASE WHEN r > 0.01 THEN 1.0 ELSE 0.0 END), 6) AS thrust_pct FROM {returns} GROUP BY ts",
    "a06_participation_score": f"SELECT ts, round(score, 6) AS score, CASE WHEN score >= 60 THEN 'BROAD' WHEN score >= 40 THEN 'MIXED' ELSE 'NARROW' END AS status FROM (SELECT ts, (coalesce(above_20, 0) + coalesce(above_50, 0) + coalesce(above_200, 0) + positive_pct) / nullif(1 + (CASE WHEN above_20 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN above_50 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN above_200 IS NULL THEN 0 ELSE 1 END), 0) AS score FROM ({_PARTICIPATION}) p) q",
    "a07_sector_breadth": f"SELECT ts, coalesce(sector, 'MARKET') AS sector, {_COUNTS}, round(100 * avg(CASE WHEN close > ma_20 THEN 1.0 ELSE 0.0 END), 6) AS above_20 FROM {{breadth}} WHERE previous_close IS NOT NULL GROUP BY ROLLUP (ts, sector) HAVING ts IS NOT NULL",
    "a08_breadth_regime": f"SELECT ts, CASE WHEN ratio >= 1.2 AND above_50 >= 50 THEN 'RISK_ON' WHEN ratio <= 0.8 AND above_50 < 50 THEN 'RISK_OFF' WHEN ratio >= 1.2 THEN 'RECOVERING' WHEN ratio <= 0.8 THEN 'WEAKENING' ELSE 'NEUTRAL' END AS label FROM (SELECT a.ts, {_RATIO} AS ratio, p.above_50 FROM ({_ADVANCE}) a JOIN ({_PARTICIPATION}) p ON a.ts = p.ts) q",
    "a09_breadth_divergence": f"SELECT ts, kind FROM (SELECT x.ts, CASE WHEN x.market > 0 AND a.advances < a.declines THEN 'INDEX_UP_BREADTH_DOWN' WHEN x.market < 0 AND a.advances > a.declines THEN 'INDEX_DOWN_BREADTH_UP' END AS kind FROM {{market}} x JOIN ({_ADVANCE}) a ON x.ts = a.ts) q WHERE kind IS NOT NULL",
    "a10_relative_strength": f"SELECT symbol, ts, round(greatest(0, least(100, 50 + 200 * (m20 + m50) / 2)), 6) AS score, round(100.0 * (rank() OVER (PARTITION BY ts ORDER BY round(m20, 9)) - 1) / count(*) OVER (PARTITION BY ts), 6) AS percentile FROM ({_RS}) q WHERE m20 IS NOT NULL AND m50 IS NOT NULL",
    "a11_sector_rotation": f"SELECT ts, sector, round(rs, 6) AS rs, row_number() OVER (PARTITION BY ts ORDER BY round(rs, 9) DESC, sector) AS place FROM (SELECT ts, sector, avg(m20) AS rs FROM ({_RS}) w WHERE m20 IS NOT NULL GROUP BY ts, sector) q",
    "a12_regime_universe": "SELECT ts, round(100 * avg(CASE WHEN close > ma_20 AND close > ma_50 THEN 1.0 ELSE 0.0 END), 6) AS risk_on_pct, round(100 * avg(CASE WHEN close < ma_20 AND close < ma_50 THEN 1.0 ELSE 0.0 END), 6) AS risk_off_pct, count(*) AS n FROM {breadth} WHERE ma_50 IS NOT NULL GROUP BY ts",
    "a13_factor_scores": f"SELECT symbol, ts, round(100 * cume_dist() OVER (PARTITION BY ts ORDER BY round(momentum, 9)), 6) AS momentum_pct, round(100 * cume_dist() OVER (PARTITION BY ts ORDER BY round(low_range, 9)), 6) AS low_range_pct, round((momentum - avg(momentum) OVER (PARTITION BY ts)) / nullif(stddev_pop(momentum) OVER (PARTITION BY ts), 0), 4) AS momentum_z FROM ({_FACTORS}) q WHERE momentum IS NOT NULL",
    "a14_factor_concentration": f"SELECT sector, ts, round(sum(w * w), 9) AS concentration, CASE WHEN sum(w * w) > 0.25 THEN 'CROWDED' ELSE 'SPREAD' END AS class FROM (SELECT sector, ts, volume / nullif(sum(volume) OVER (PARTITION BY sector, ts), 0) AS w FROM ({_FACTORS}) f) q GROUP BY sector, ts",
    "a15_valuation_multiples": f"SELECT symbol, period, round(pe, 4) AS pe, round(ev_sales, 4) AS ev_sales, round(earnings_yield, 6) AS earnings_yield, CASE WHEN profit <= 0 THEN 'WATCH' ELSE 'OK' END AS status FROM ({_MULTIPLES}) q",
    "a16_historical_band": f"SELECT symbol, n, round(low, 4) AS low, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(high, 4) AS high FROM (SELECT symbol, count(pe) AS n, min(pe) AS low, exact_percentile(pe, 0.25) AS p25, exact_percentile(pe, 0.5) AS p50, exact_percentile(pe, 0.75) AS p75, max(pe) AS high FROM ({_MULTIPLES}) q GROUP BY symbol) w WHERE n >= 8",
    "a19_ratios": "SELECT symbol, period, round(profit / nullif(revenue, 0), 6) AS margin, round(debt / nullif(revenue, 0), 6) AS debt_to_revenue FROM {statements}",
    "a21_earnings_quality": "SELECT symbol, period, CASE WHEN profit / nullif(revenue, 0) >= 0.2 AND debt <= 0.5 * revenue THEN 'HIGH' WHEN profit / nullif(revenue, 0) < 0.12 OR debt > revenue * 0.9 THEN 'LOW' ELSE 'MEDIUM' END AS quality FROM {statements}",
    "a22_statement_pivot": "SELECT symbol, fiscal_year, round(sum(CASE WHEN fiscal_quarter = 1 THEN revenue END), 2) AS q1, round(sum(CASE WHEN fiscal_quarter = 2 THEN revenue END), 2) AS q2, round(sum(CASE WHEN fiscal_quarter = 3 THEN revenue END), 2) AS q3, round(sum(CASE WHEN fiscal_quarter = 4 THEN revenue END), 2) AS q4 FROM {statements} GROUP BY symbol, fiscal_year",
    "a23_event_risk": "SELECT user_id, CAST(ts AS DATE) AS day, least(100, sum(CASE event_type WHEN 'error' THEN 50 WHEN 'purchase' THEN 30 WHEN 'click' THEN 15 ELSE 5 END)) AS risk, CASE WHEN sum(CASE event_type WHEN 'error' THEN 50 WHEN 'purchase' THEN 30 WHEN 'click' THEN 15 ELSE 5 END) >= 80 THEN 'BLOCK' WHEN sum(CASE event_type WHEN 'error' THEN 50 WHEN 'purchase' THEN 30 WHEN 'click' THEN 15 ELSE 5 END) >= 40 THEN 'REDUCE' ELSE 'ALLOW' END AS decision FROM {events} GROUP BY user_id, CAST(ts AS DATE)",
    "a24_profile": "SELECT count(*) AS n, count_if(l_shipdate IS NULL) AS null_dates, count(*) - count(DISTINCT l_orderkey * 100 + l_linenumber) AS duplicates, min(l_quantity) AS low_quantity, max(l_quantity) AS high_quantity, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day FROM {lineitem}",
    "a28_frame_quality": "SELECT symbol, round(avg(CASE WHEN previous_close IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_ratio, count(DISTINCT close) <= 1 AS is_constant, max(ts) AS newest FROM {breadth} GROUP BY symbol",
    "a29_import_findings": "SELECT finding, n FROM (SELECT 'negative_price' AS finding, count_if(l_extendedprice < 0) AS n FROM {lineitem} UNION ALL SELECT 'zero_quantity', count_if(l_quantity = 0) FROM {lineitem} UNION ALL SELECT 'repeated_row', count(*) - count(DISTINCT l_orderkey * 100 + l_linenumber) FROM {lineitem}) q",
    "a30_outcome_summary": "SELECT strategy, state, count(*) AS n, round(avg(net_return), 4) AS mean_return, round(avg(hit), 6) AS hit_rate FROM {outcomes} GROUP BY strategy, state",
    "a31_repeated_patterns": "SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_case FROM {events} GROUP BY user_id, event_type HAVING count(*) >= 3",
    "a32_attribution_sets": "SELECT coalesce(CAST(strategy AS VARCHAR(20)), 'ALL') AS strategy, coalesce(CAST(regime AS VARCHAR(20)), 'ALL') AS regime, count(*) AS n, round(avg(CASE WHEN gross_return > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(gross_return), 6) AS mean_return FROM {trades} GROUP BY GROUPING SETS ((strategy), (regime), ())",
    "a33_case_patterns": "SELECT strategy, hit, n, row_number() OVER (PARTITION BY hit ORDER BY n DESC, strategy) AS place FROM (SELECT strategy, hit, count(*) AS n FROM {outcomes} GROUP BY strategy, hit) q",
    # Sorts, limits, sets.
    "t01_scan_ranking": "SELECT symbol, score, passed, CASE WHEN passed THEN row_number() OVER (PARTITION BY passed ORDER BY score DESC NULLS LAST, symbol DESC) ELSE 9999 END AS place FROM (SELECT symbol, max(score) AS score, max(score) >= 50 AS passed FROM {outcomes} GROUP BY symbol) q",
    "t02_cross_section_rank": "SELECT symbol, ts, place, round((n - place + 1.0) / n, 6) AS percentile FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY ts ORDER BY round(0.7 * r + 0.3 * volume / 1000, 9) DESC, symbol DESC) AS place, count(*) OVER (PARTITION BY ts) AS n FROM {returns}) q",
    "t03_min_max": "SELECT symbol, ts, round(CASE WHEN max(close) OVER (PARTITION BY ts) = min(close) OVER (PARTITION BY ts) THEN 50.0 ELSE 100 * (close - min(close) OVER (PARTITION BY ts)) / nullif(max(close) OVER (PARTITION BY ts) - min(close) OVER (PARTITION BY ts), 0) END, 6) AS scaled FROM {bars}",
    "t04_best_runs": "SELECT strategy, score, net_return FROM (SELECT strategy, round(avg(score), 6) AS score, round(avg(net_return), 6) AS net_return FROM {outcomes} GROUP BY strategy) q ORDER BY net_return DESC, strategy LIMIT 3",
    "t05_top_exposures": "SELECT symbol, notional FROM (SELECT symbol, round(sum(notional), 2) AS notional FROM {trades} GROUP BY symbol) q ORDER BY notional DESC, symbol LIMIT 10",
    "t06_candidates": "SELECT symbol, ts, score, place FROM (SELECT symbol, ts, score, row_number() OVER (PARTITION BY ts ORDER BY score DESC, signal_id) AS place FROM {outcomes} WHERE score >= 40) q WHERE place <= 5",
    "u02_union_votes": "SELECT symbol, source, direction FROM (SELECT symbol, 'technical' AS source, CASE WHEN close > ma_20 THEN 'LONG' ELSE 'SHORT' END AS direction FROM {breadth} WHERE ma_20 IS NOT NULL UNION ALL SELECT symbol, 'fundamental', CASE WHEN size > 0 THEN 'LONG' ELSE 'SHORT' END FROM {instruments}) q",
    "u04_intersection": "SELECT s_nationkey AS nation FROM {supplier} INTERSECT SELECT c_nationkey FROM {customer}",
    "u05_distinct_edges": "SELECT DISTINCT o_custkey AS a, o_orderpriority AS b FROM {orders}",
}

STATEMENTS = {n: Statement(text, S) for n, text in TEXTS.items()}
