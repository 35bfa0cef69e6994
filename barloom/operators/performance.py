"""Performance, portfolio, cost, stress and resampling statements."""

from __future__ import annotations

from barloom.operators.crosssection import S
from barloom.plans.statements import Statement

_EQUITY = "SELECT symbol, ts, r, sum(CASE WHEN r > -1 THEN ln(1 + r) ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le FROM {returns}"
_DRAWDOWN = f"SELECT symbol, ts, exp(le) AS equity, max(exp(le)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM ({_EQUITY}) e"
_NET = "SELECT *, gross_return - cost_rate AS net FROM {trades}"
_SYMBOLS = "SELECT symbol, avg(r) AS mean_r, stddev_samp(r) AS sd, count(*) AS n FROM {returns} GROUP BY symbol"
_SCENARIOS = "(VALUES ('base', 5.0, 10.0), ('high', 15.0, 30.0)) AS c(scenario, commission_bps, slippage_bps)"
_STAKES = "SELECT symbol, sector, sum(weight) AS weight, sum(notional) AS notional FROM {positions} GROUP BY symbol, sector"
_RUNS = "SELECT symbol, ts, under, CASE WHEN under = lag(under) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS fresh FROM (SELECT symbol, ts, CASE WHEN equity < peak THEN 1 ELSE 0 END AS under FROM ({0}) d) u"
_LOSS_RUNS = "SELECT strategy, trade_id, symbol, notional, net, loss, CASE WHEN loss = lag(loss) OVER (PARTITION BY strategy ORDER BY trade_id, symbol, notional, net) THEN 0 ELSE 1 END AS fresh FROM (SELECT strategy, trade_id, symbol, notional, net, CASE WHEN net < 0 THEN 1 ELSE 0 END AS loss FROM ({0}) n) u"

TEXTS = {
    "we2_longest_underwater": f"SELECT symbol, max(n) AS longest FROM (SELECT symbol, run, count(*) AS n FROM (SELECT symbol, under, sum(fresh) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ({_RUNS.replace('{0}', _DRAWDOWN)}) f) g WHERE under = 1 GROUP BY symbol, run) h GROUP BY symbol",
    "we3_loss_streaks": f"SELECT strategy, max(n) AS worst, round(avg(n), 6) AS mean_streak FROM (SELECT strategy, run, count(*) AS n FROM (SELECT strategy, loss, sum(fresh) OVER (PARTITION BY strategy ORDER BY trade_id, symbol, notional, net ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ({_LOSS_RUNS.replace('{0}', _NET)}) f) g WHERE loss = 1 GROUP BY strategy, run) h GROUP BY strategy",
    "b01_return_metrics": "SELECT symbol, n, round(exp(lg) - 1, 4) AS total_return, round(sd * sqrt(252), 6) AS volatility, round(mean_r / nullif(sd, 0) * sqrt(252), 6) AS sharpe, round(mean_r / nullif(down, 0) * sqrt(252), 6) AS sortino FROM (SELECT symbol, count(*) AS n, sum(CASE WHEN r > -1 THEN ln(1 + r) ELSE 0 END) AS lg, avg(r) AS mean_r, stddev_samp(r) AS sd, CASE WHEN count_if(r < 0) >= 2 THEN sqrt(avg(CASE WHEN r < 0 THEN r * r END)) END AS down FROM {returns} GROUP BY symbol) q",
    "b02_var_cvar": "SELECT q.symbol, round(q.v, 6) AS var_95, round(avg(CASE WHEN x.r <= q.v THEN x.r END), 6) AS cvar_95 FROM (SELECT symbol, exact_percentile(r, 0.05) AS v FROM {returns} GROUP BY symbol HAVING count(*) >= 5) q JOIN {returns} x ON x.symbol = q.symbol GROUP BY q.symbol, q.v",
    "b03_trade_metrics": f"SELECT strategy, count(*) AS n, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(net), 6) AS mean_net, round(max(net), 6) AS best, round(min(net), 6) AS worst, round(sum(CASE WHEN net > 0 THEN net ELSE 0 END) / nullif(-sum(CASE WHEN net < 0 THEN net ELSE 0 END), 0), 6) AS profit_factor, round(avg(bars_held), 6) AS holding FROM ({_NET}) q GROUP BY strategy",
    "b04_performance_by_regime": f"SELECT strategy, regime, round(sum(notional * cost_rate), 2) AS cost, round(sum(notional * net), 2) AS net_value, round(avg(net), 6) AS mean_net FROM ({_NET}) q GROUP BY strategy, regime",
    "b05_strategy_vs_benchmark": "SELECT x.symbol, round(avg(x.r - m.market) * 252, 6) AS excess, round(avg(x.r - m.market) / nullif(stddev_samp(x.r - m.market), 0) * sqrt(252), 6) AS information_ratio FROM {returns} x JOIN {market} m ON x.ts = m.ts GROUP BY x.symbol",
    "b06_monitoring_metrics": f"SELECT symbol, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(net) / nullif(stddev_pop(net), 0), 6) AS sharpe_like FROM ({_NET}) q GROUP BY symbol",
    "b07_trade_costs": f"SELECT c.scenario, t.strategy, round(sum(greatest(t.notional * c.commission_bps / 10000, 1.0)), 2) AS commission, round(sum(t.notional * c.slippage_bps / 10000 * sqrt(t.quantity / 50)), 2) AS slippage, round(sum(t.notional * CASE WHEN t.notional >= 50000 THEN 2 WHEN t.notional >= 20000 THEN 5 ELSE 10 END / 10000.0), 2) AS spread FROM {{trades}} t CROSS JOIN {_SCENARIOS} GROUP BY c.scenario, t.strategy",
    "b09_fill_quality": "SELECT symbol, strategy, round(avg(quantity) / 50, 6) AS fill_rate, round(avg(cost_rate) * 10000, 4) AS cost_bps, round(avg(gross_return) - avg(cost_rate), 6) AS net FROM {trades} GROUP BY symbol, strategy",
    "b10_weights": f"SELECT symbol, round(1.0 / count(*) OVER (), 9) AS equal_weight, round((1 / nullif(sd, 0)) / sum(1 / nullif(sd, 0)) OVER (), 9) AS inverse_volatility, round(greatest(mean_r, 0) / nullif(sum(greatest(mean_r, 0)) OVER (), 0), 9) AS score_weight FROM ({_SYMBOLS}) q",
    "b11_weight_caps": f"SELECT symbol, sector, round(capped * least(1.0, 0.3 / nullif(sum(capped) OVER (PARTITION BY sector), 0)), 9) AS weight FROM (SELECT symbol, sector, least(weight, 0.02) AS capped FROM ({_STAKES}) p) q WHERE capped >= 0.001",
    "b12_exposure": "SELECT coalesce(sector, 'ALL') AS sector, coalesce(strategy, 'ALL') AS strategy, round(sum(weight), 9) AS gross, count(*) AS n FROM {positions} GROUP BY CUBE (sector, strategy)",
    "b13_constraint_violations": "SELECT kind, name, round(weight, 9) AS weight FROM (SELECT 'sector' AS kind, sector AS name, sum(weight) AS weight FROM {positions} GROUP BY sector UNION ALL SELECT 'strategy', strategy, sum(weight) FROM {positions} GROUP BY strategy) q WHERE weight > 0.25",
    "b17_diversification": f"SELECT round(sum(weight * weight), 9) AS hhi, round(1 / nullif(sum(weight * weight), 0), 4) AS effective_n, count(DISTINCT sector) AS sectors FROM ({_STAKES}) q",
    "b18_turnover": f"SELECT coalesce(a.symbol, b.symbol) AS symbol, round(coalesce(b.w, 0) - coalesce(a.w, 0), 9) AS delta, CASE WHEN coalesce(b.w, 0) - coalesce(a.w, 0) > 0.0005 THEN 'BUY' WHEN coalesce(b.w, 0) - coalesce(a.w, 0) < -0.0005 THEN 'SELL' ELSE 'HOLD' END AS action FROM (SELECT symbol, weight AS w FROM ({_STAKES}) x) a FULL OUTER JOIN (SELECT symbol, greatest(mean_r, 0) / nullif(sum(greatest(mean_r, 0)) OVER (), 0) AS w FROM ({_SYMBOLS}) y) b ON a.symbol = b.symbol",
    "b19_basket_curve": f"SELECT x.ts, round(sum(p.weight * x.r) / nullif(sum(p.weight), 0), 9) AS basket_return FROM {{returns}} x JOIN ({_STAKES}) p ON x.symbol = p.symbol GROUP BY x.ts",
    "b20_attribution": f"SELECT coalesce(CAST(symbol AS VARCHAR(20)), 'ALL') AS symbol, coalesce(strategy, 'ALL') AS strategy, round(sum(notional * net), 2) AS value, round(sum(notional * cost_rate) / nullif(sum(notional), 0) * 10000, 4) AS drag_bps FROM ({_NET}) q GROUP BY GROUPING SETS ((symbol), (strategy), ())",
    "b21_outcome_labels": "SELECT signal_id, CASE WHEN net_return >= 2 THEN 'WIN' WHEN net_return >= 0.5 THEN 'SMALL_WIN' WHEN net_return > -0.5 THEN 'FLAT' WHEN net_return > -2 THEN 'SMALL_LOSS' ELSE 'LOSS' END AS label FROM {outcomes}",
    "b22_shock_impact": "SELECT c.scenario, round(sum(p.weight * (c.market_shock + CASE WHEN p.sector = c.sector THEN c.sector_shock ELSE 0 END)) / nullif(sum(p.weight), 0), 9) AS impact FROM {positions} p CROSS JOIN (VALUES ('crash', -0.2, 'ASIA', -0.1), ('rally', 0.1, 'EUROPE', 0.05)) AS c(scenario, market_shock, sector, sector_shock) GROUP BY c.scenario",
    "b23_return_summary": "SELECT symbol, count(*) AS n, round(avg(r), 9) AS mean_r, round(stddev_pop(r), 9) AS sd, round(min(r), 9) AS low, round(max(r), 9) AS high FROM {returns} GROUP BY symbol",
    "b24_loss_buffer": f"SELECT symbol, round(greatest(0, -(mean_r * 21 - 1.645 * sd * sqrt(21))), 6) AS buffer FROM ({_SYMBOLS}) q",
    "b26_tail_probabilities": "SELECT symbol, round(avg(CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END), 6) AS p_loss, round(avg(CASE WHEN r < -0.2 THEN 1.0 ELSE 0.0 END), 6) AS p_deep, round((count_if(r < 0.01) + 0.5 * count_if(r = 0.01)) / count(*), 6) AS midrank FROM {returns} GROUP BY symbol",
    "b27_cost_sensitivity": f"SELECT a.strategy, round(a.net - b.net, 9) AS delta, CASE WHEN abs(a.net - b.net) > 0.01 THEN 'HIGH' WHEN abs(a.net - b.net) > 0.002 THEN 'MEDIUM' ELSE 'LOW' END AS severity, rank() OVER (ORDER BY round(a.net - b.net, 9)) AS place FROM (SELECT strategy, avg(gross_return - 2 * cost_rate) AS net FROM ({_NET}) x GROUP BY strategy) a JOIN (SELECT strategy, avg(net) AS net FROM ({_NET}) y GROUP BY strategy) b ON a.strategy = b.strategy",
    "b28_capital_scaling": "SELECT c.capital, p.symbol, round(c.capital * p.weight / nullif(q.turnover, 0), 6) AS participation, CASE WHEN c.capital * p.weight > 0.05 * q.turnover THEN 1 ELSE 0 END AS over_limit FROM (SELECT symbol, sum(weight) AS weight FROM {positions} GROUP BY symbol) p JOIN (SELECT symbol, avg(close * volume) AS turnover FROM {returns} GROUP BY symbol) q ON p.symbol = q.symbol CROSS JOIN (VALUES (100000), (1000000), (10000000)) AS c(capital)",
    "b29_objective_grid": f"SELECT g.target, g.hold, strategy, round(avg(CASE WHEN bars_held <= g.hold AND gross_return >= g.target THEN net ELSE 0 END), 9) AS objective FROM ({_NET}) t CROSS JOIN (VALUES (0.0, 5), (0.0, 10), (0.02, 5), (0.02, 10)) AS g(target, hold) GROUP BY g.target, g.hold, strategy",
    "b30_parameter_stability": f"SELECT strategy, round(stddev_samp(m), 9) AS spread, round(avg(m), 9) AS mean_net, round(max(CASE WHEN fold = 3 THEN m END) - avg(CASE WHEN fold < 3 THEN m END), 9) AS decay FROM (SELECT strategy, bars_held % 4 AS fold, avg(net) AS m FROM ({_NET}) x GROUP BY strategy, bars_held % 4) q GROUP BY strategy",
}

STATEMENTS = {n: Statement(text, S) for n, text in TEXTS.items()}
