"""Cleaning, as-of and interval joins, resampling and retrieval: statements over the given tables."""

from __future__ import annotations

from barloom.operators.crosssection import S as BASE
from barloom.plans.statements import Statement, table
from barloom.sources.tables import derived

_W = "OVER (PARTITION BY symbol ORDER BY ts"
#: Orders as corporate actions of a supplier's symbol: one split for each symbol and year, factor by priority.
ACTIONS = derived(
    "SELECT DISTINCT l_suppkey AS symbol, CAST(date_trunc('year', l_shipdate) AS DATE) AS action_date, CASE WHEN l_suppkey % 3 = 0 THEN 2.0 ELSE 1.0 END AS ratio FROM {lineitem}", lineitem=table("lineitem"),
)
#: Closed windows of days around error events of a user.
WINDOWS = derived("SELECT user_id, min(CAST(ts AS DATE)) AS starts, max(CAST(ts AS DATE)) AS ends, event_type AS kind FROM {events} WHERE event_type IN ('error', 'purchase') GROUP BY user_id, event_type, extract(week FROM ts)", events=table("events", "user_id, ts, event_type"))
S = BASE | {"actions": ACTIONS, "windows": WINDOWS}

_WEEK = "CAST(date_trunc('week', ts) AS DATE)"
_MONTH = "CAST(date_trunc('month', ts) AS DATE)"
_RESAMPLED = "SELECT symbol, {p} AS period, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by(close, ts) AS close, sum(volume) AS volume, max(ts) AS last_ts FROM {{bars}} GROUP BY symbol, {p}"
_WEEKS, _MONTHS = _RESAMPLED.replace("{{bars}}", "{bars}").replace("{p}", _WEEK), _RESAMPLED.replace("{{bars}}", "{bars}").replace("{p}", _MONTH)
#: As-of: both sides in one sorted window, the last known right value carried forward; no range join.
_ASOF = f"SELECT symbol, ts, close, last_value(right_close) IGNORE NULLS {_W}, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS higher_close, side FROM (SELECT symbol, ts, close, CAST(NULL AS DOUBLE) AS right_close, 1 AS side FROM {{bars}} UNION ALL SELECT symbol, last_ts, NULL, close, 0 FROM ({_WEEKS}) w) u"
_FACTORS = "SELECT symbol, action_date, exp(sum(ln(1 / ratio)) OVER (PARTITION BY symbol ORDER BY action_date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS factor FROM {actions}"
_NEXT_FACTOR = f"SELECT symbol, ts, close, first_value(f) IGNORE NULLS {_W}, side ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor, side FROM (SELECT symbol, ts, close, CAST(NULL AS DOUBLE) AS f, 1 AS side FROM {{bars}} UNION ALL SELECT symbol, action_date, NULL, factor, 2 FROM ({_FACTORS}) x) u"
_DUPLICATED = "SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts, l_extendedprice AS price, l_orderkey * 100 + l_linenumber AS place FROM {lineitem}"
TEXTS = {
    # Sources and increments.
    "s12_refresh_plan": "SELECT symbol, max(ts) AS newest, CASE WHEN max(ts) >= DATE '2001-10-20' THEN 'SKIP' WHEN max(ts) >= DATE '2001-09-01' THEN 'FROM_LAST' ELSE 'FULL' END AS plan, count_if(gap > 3) AS gaps FROM (SELECT symbol, ts, day_number(ts) - day_number(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM {bars}) q GROUP BY symbol",
    "s13_provider_fallback": "SELECT symbol, ts, close, source FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY priority) AS place FROM (SELECT symbol, ts, close, 'primary' AS source, 1 AS priority FROM {bars} WHERE volume > 30 UNION ALL SELECT symbol, ts, open, 'fallback', 2 FROM {bars}) u) q WHERE place = 1",
    # Projections and filters.
    "p03_keep_last_stamp": f"SELECT symbol, ts, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY place DESC, price DESC) AS k FROM ({_DUPLICATED}) d) q WHERE k = 1",
    "p04_numeric_text": "SELECT o_orderkey, TRY_CAST(replace(replace(replace(t, '.', ''), ',', '.'), ' ', '') AS DOUBLE) AS price FROM (SELECT o_orderkey, replace(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) || ',5', 'x', '') AS t FROM {orders}) q",
    "p17_universe": "SELECT symbol, sector FROM {instruments} WHERE status = 'ACTIVE' AND sector IN ('ASIA', 'EUROPE') AND symbol NOT IN (1, 2, 3)",
    "p18_symbol_form": "SELECT symbol, upper(trim(replace_all(name, '#0*', '.'))) AS canonical FROM {instruments}",
    "p19_rejected_rows": "SELECT trade_id, CASE WHEN quantity <= 0 THEN 'QUANTITY' WHEN gross_return > 0.05 THEN 'RETURN' END AS reason FROM {trades} WHERE quantity <= 0 OR gross_return > 0.05",
    "p20_scan_filter": "SELECT signal_id, CASE WHEN score < 20 THEN 'LOW_SCORE' WHEN net_return < -1 THEN 'RISK_REJECT' WHEN state = 'P' THEN 'WATCH_ONLY' ELSE 'PASS' END AS status FROM {outcomes}",
    "p21_risk_predicates": "SELECT trade_id, notional <= 90000 AS position_ok, cost_rate <= 0.0007 AS cost_ok, bars_held <= 15 AS holding_ok FROM {trades}",
    "p22_ledger_query": "SELECT signal_id, strategy, score FROM {outcomes} WHERE strategy = '1-URGENT' AND score >= 90 ORDER BY score DESC, signal_id LIMIT 50",
    "p23_as_of_scope": "SELECT symbol, count(*) AS n, max(ts) AS newest FROM {bars} WHERE ts <= DATE '1998-06-30' GROUP BY symbol",
    # Joins.
    "j01_source_comparison": f"SELECT a.symbol, count(*) AS n, round(max(abs(a.close - b.close) / nullif(a.close, 0)), 6) AS worst, count_if(abs(a.close - b.close) / nullif(a.close, 0) > 0.01) AS off FROM {{bars}} a JOIN ({_WEEKS}) b ON a.symbol = b.symbol AND a.ts = b.period GROUP BY a.symbol",
    "j06_event_windows": "SELECT e.user_id, w.kind, count(*) AS n FROM {events} e JOIN {windows} w ON e.user_id = w.user_id AND CAST(e.ts AS DATE) BETWEEN w.starts AND w.ends GROUP BY e.user_id, w.kind",
    "j07_events_around": "SELECT a.user_id, count(*) AS pairs FROM {events} a JOIN {events} b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND abs(day_number(CAST(a.ts AS DATE)) - day_number(CAST(b.ts AS DATE))) <= 2 GROUP BY a.user_id",
    "j08_peer_group": "SELECT symbol, sector, count(*) OVER (PARTITION BY sector) - 1 AS peers, round((sum(size) OVER (PARTITION BY sector) - size) / nullif(count(*) OVER (PARTITION BY sector) - 1, 0), 6) AS peer_mean FROM {instruments}",
    "j09_prior_periods": "SELECT a.symbol, a.period, round(a.revenue / nullif(b.revenue, 0) - 1, 6) AS yoy FROM {statements} a JOIN {statements} b ON a.symbol = b.symbol AND a.fiscal_quarter = b.fiscal_quarter AND a.fiscal_year = b.fiscal_year + 1",
    "j12_weight_join": "SELECT coalesce(a.symbol, b.symbol) AS symbol, round(coalesce(a.w, 0), 9) AS current_w, round(coalesce(b.w, 0), 9) AS target_w FROM (SELECT symbol, weight AS w FROM {positions} WHERE strategy = 'A') a FULL OUTER JOIN (SELECT symbol, weight AS w FROM {positions} WHERE strategy = 'R') b ON a.symbol = b.symbol",
    "j14_feature_coverage": "SELECT p.p_brand, count(*) AS n FROM {part} p LEFT SEMI JOIN {lineitem} l ON p.p_partkey = l.l_partkey GROUP BY p.p_brand",
    "j16_signal_events": "SELECT o.signal_id, count(e.event_id) AS n_events FROM {outcomes} o LEFT JOIN {events} e ON e.user_id = o.symbol AND e.event_type = 'error' GROUP BY o.signal_id",
    "j17_benchmark_excess": "SELECT x.symbol, x.ts, round(x.r - m.market, 6) AS excess FROM {returns} x JOIN {market} m ON x.ts = m.ts",
    "j18_position_values": "SELECT p.symbol, p.strategy, round(p.weight * b.last_close, 6) AS value FROM {positions} p JOIN (SELECT symbol, max_by(close, ts) AS last_close FROM {bars} GROUP BY symbol) b ON p.symbol = b.symbol",
    # Resampling.
    "r01_monthly_bars": f"SELECT symbol, period, open, high, low, close, volume FROM (SELECT *, max(period) OVER (PARTITION BY symbol) AS last_period FROM ({_MONTHS}) m) q WHERE period < last_period",
    "r02_multi_timeframe": f"SELECT q.symbol, q.ts, round(q.close / nullif(q.higher_close, 0) - 1, 6) AS off_week FROM ({_ASOF}) q WHERE q.side = 1",
    "r03_incremental_merge": "SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY loaded DESC) AS k FROM (SELECT symbol, ts, close, 1 AS loaded FROM {bars} UNION ALL SELECT symbol, ts, open, 2 FROM {bars} WHERE ts >= DATE '2001-01-01') u) q WHERE k = 1",
    "r04_dedup_by_key": "SELECT symbol, fiscal_year, signal_id FROM (SELECT symbol, CAST(extract(year FROM ts) AS INT) AS fiscal_year, signal_id, row_number() OVER (PARTITION BY symbol, extract(year FROM ts) ORDER BY ts DESC, signal_id DESC) AS k FROM {outcomes}) q WHERE k = 1",
    "wx1_statement_trends": "SELECT symbol, period, round(revenue / nullif(lag(revenue) OVER (PARTITION BY symbol ORDER BY period), 0) - 1, 6) AS qoq, round(sum(revenue) OVER (PARTITION BY symbol ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS ttm FROM {statements}",
    "wl3_filled_features": f"SELECT symbol, ts, last_value(x) IGNORE NULLS {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM (SELECT symbol, ts, CASE WHEN volume >= 60 THEN close END AS x FROM {{bars}}) q",
    # Learning tables.
    "m03_winsorised": "SELECT x.symbol, x.ts, CASE WHEN x.r IS NOT NULL THEN round(least(greatest(x.r, q.low), q.high), 6) END AS r FROM {returns} x CROSS JOIN (SELECT exact_percentile(r, 0.01) AS low, exact_percentile(r, 0.99) AS high FROM {returns} WHERE ts < DATE '1999-01-01') q",
    "m05_purged_folds": "SELECT fold, count_if(day < lo - 5 OR day > hi + 5) AS train_rows, count_if(day BETWEEN lo AND hi) AS test_rows FROM (SELECT f.fold, day_number(r.ts) AS day, 9131 + f.fold * 500 AS lo, 9131 + f.fold * 500 + 499 AS hi FROM {returns} r CROSS JOIN (VALUES (0), (1), (2), (3)) AS f(fold)) q GROUP BY fold",
    "m11_features_as_of": "SELECT symbol, max_by(close, ts) AS close, max_by(ma_20, ts) AS ma_20, max(ts) AS feature_ts FROM {breadth} WHERE ts <= DATE '2000-01-01' GROUP BY symbol",
    # Text.
    "f10_disclosure_type": "SELECT doc_id, CASE WHEN matches_of(text, 'Licensed|licensed') THEN 'LICENSE' WHEN matches_of(text, '@mail[0-9]') THEN 'CONTACT' WHEN matches_of(text, 'password=') THEN 'SECRET' ELSE 'OTHER' END AS kind FROM {documents}",
    "f11_risk_tags": "SELECT tag, count(*) AS n FROM (SELECT 'secret' AS tag FROM {documents} WHERE matches_of(text, 'password=|AKIA[A-Z0-9]') UNION ALL SELECT 'contact' FROM {documents} WHERE matches_of(text, '@mail[0-9]') UNION ALL SELECT 'insult' FROM {documents} WHERE matches_of(text, 'idiot|moron|stupid')) q GROUP BY tag",
    "f14_narrative_risk": "SELECT source, round(avg(CASE WHEN matches_of(text, 'password=') THEN 40.0 WHEN matches_of(text, 'idiot|moron') THEN 25.0 ELSE 5.0 END), 6) AS risk FROM {documents} GROUP BY source",
    "f15_digest": "SELECT source, lang, count(*) AS n, max(n_chars) AS longest FROM {documents} GROUP BY source, lang",
    "f16_proxy_direction": "SELECT ts, CASE WHEN market > lag(market) OVER (ORDER BY ts) THEN 'PRESSURE' ELSE 'RELIEF' END AS direction FROM {market}",
    "f17_math": "SELECT signal_id, round(ln(1 + score), 6) AS log_score, round(sqrt(abs(net_return)), 6) AS root, floor(score) AS whole, sign(net_return) * 1.0 AS side FROM {outcomes}",
    "f18_dates": "SELECT signal_id, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(extract(month FROM ts) AS INT) AS m, day_number(ts) - day_number(DATE '1995-01-01') AS days FROM {outcomes}",
    "s07_long_statements": "SELECT symbol, period, item, round(amount, 4) AS amount FROM (SELECT symbol, period, 'revenue' AS item, revenue AS amount FROM {statements} UNION ALL SELECT symbol, period, 'profit', profit FROM {statements} UNION ALL SELECT symbol, period, 'debt', debt FROM {statements}) q",
    "s06_preview": "SELECT count(*) AS n, count(DISTINCT l_returnflag) AS flags, min(l_quantity) AS low, max(l_quantity) AS high, count(*) - count(l_tax) AS empty_tax FROM {lineitem}",
    "x08_daily_drift": "SELECT e.day, round(e.m - b.m, 6) AS shift, CASE WHEN abs(e.m - b.m) > 0.5 * b.s THEN 1 ELSE 0 END AS drifted FROM (SELECT CAST(ts AS DATE) AS day, avg(value) AS m FROM {events} GROUP BY CAST(ts AS DATE)) e CROSS JOIN (SELECT avg(value) AS m, stddev_pop(value) AS s FROM {events} WHERE ts < TIMESTAMP '2024-01-08 00:00:00') b",
    "m10_attribution_shares": "SELECT symbol, ts, feature, round(abs(x) / nullif(sum(abs(x)) OVER (PARTITION BY symbol, ts), 0), 6) AS share FROM (SELECT symbol, ts, 'distance' AS feature, close / nullif(ma_20, 0) - 1 AS x FROM {breadth} WHERE ma_20 IS NOT NULL UNION ALL SELECT symbol, ts, 'momentum', close / nullif(close_20_ago, 0) - 1 FROM {breadth} WHERE ma_20 IS NOT NULL UNION ALL SELECT symbol, ts, 'range', (high - low) / nullif(close, 0) FROM {breadth} WHERE ma_20 IS NOT NULL) q",
    "x02_fingerprint": "SELECT signal_id, hash_text(CAST(symbol AS VARCHAR(20)) || '|' || strategy || '|' || CAST(CAST(floor(score) AS BIGINT) AS VARCHAR(20))) AS fingerprint FROM {outcomes}",
    "x05_watchlist_expiry": "SELECT symbol, ts FROM {outcomes} WHERE score >= 90 AND ts >= DATE '2000-12-01'",
}

_OTHER = {"LEFT ANTI JOIN": "ANTI JOIN", "LEFT SEMI JOIN": "SEMI JOIN", ") IGNORE NULLS": " IGNORE NULLS)"}
STATEMENTS = {n: Statement(text, S, _OTHER) for n, text in TEXTS.items()}
