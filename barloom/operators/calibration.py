"""Calibration, drift, monitoring, ensembles and scorecards: statements over outcomes, embeddings and votes."""

from __future__ import annotations

from barloom.operators.crosssection import S
from barloom.plans.statements import Statement

_BINNED = "SELECT strategy, CAST(least(floor(score / 10), 9) AS INT) AS bin, score, hit, net_return FROM {outcomes}"
_BINS = f"SELECT strategy, bin, count(*) AS n, avg(score) / 100 AS mean_score, avg(hit) AS rate, avg(net_return) AS mean_return FROM ({_BINNED}) b GROUP BY strategy, bin"
_SIDES = "SELECT score AS x, CASE WHEN ts < DATE '1997-01-01' THEN 'ref' ELSE 'cur' END AS side FROM {outcomes}"
_RANGE = f"SELECT min(x) AS low, max(x) AS high FROM ({_SIDES}) r"
_PSI_BINS = f"SELECT CAST(least(floor((x - low) / nullif(high - low, 0) * 10), 9) AS INT) AS bin, count_if(side = 'ref') AS nr, count_if(side = 'cur') AS nc FROM ({_SIDES}) s CROSS JOIN ({_RANGE}) g GROUP BY 1"
_CDF = f"SELECT x, sum(nr) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (sum(nr) OVER () + 0.0) AS fr, sum(nc) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (sum(nc) OVER () + 0.0) AS fc, lead(x) OVER (ORDER BY x) - x AS gap FROM (SELECT CAST(floor(x) AS INT) AS x, count_if(side = 'ref') AS nr, count_if(side = 'cur') AS nc FROM ({_SIDES}) s GROUP BY 1) q"
_VOTES = "SELECT symbol, sector, 'technical' AS source, CASE WHEN close > ma_20 THEN 'LONG' ELSE 'SHORT' END AS direction, 60.0 AS score, 1.0 AS weight FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS newest FROM {breadth}) b WHERE ma_20 IS NOT NULL AND ts = newest UNION ALL SELECT symbol, sector, 'fundamental', CASE WHEN size > 5000 THEN 'LONG' WHEN size < 0 THEN 'SHORT' ELSE 'NEUTRAL' END, 55.0, 0.8 FROM {instruments} UNION ALL SELECT symbol, sector, 'momentum', CASE WHEN r > 0 THEN 'LONG' ELSE 'SHORT' END, 50.0, 0.5 FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS newest FROM {returns}) n WHERE ts = newest"
_LEDGER = "SELECT strategy, count(*) AS n, avg(hit) AS hit_rate, avg(net_return) AS mean_return, stddev_samp(net_return) AS sd, avg(score) AS score FROM {outcomes} GROUP BY strategy"
_PERIODS = "SELECT strategy, CASE WHEN ts < DATE '1997-01-01' THEN 'ref' ELSE 'cur' END AS period, count(*) AS n, avg(hit) AS hit_rate, avg(net_return) AS mean_return, avg(score) AS score, avg(CASE WHEN score >= 50 THEN 1.0 ELSE 0.0 END) AS alert_rate, stddev_pop(score) AS sd FROM {outcomes} GROUP BY 1, 2"
_SHIFT = f"SELECT strategy, max(CASE WHEN period = 'ref' THEN {{c}} END) AS a, max(CASE WHEN period = 'cur' THEN {{c}} END) AS b, min(n) AS n FROM ({_PERIODS}) p GROUP BY strategy"


def _shift(c: str) -> str:
    return _SHIFT.replace("{c}", c)


TEXTS = {
    "c01_outcome_label": "SELECT signal_id, CASE WHEN net_return >= 2 THEN 'SUCCESS' WHEN net_return <= -2 THEN 'FAILURE' WHEN net_return > 0 THEN 'PARTIAL' ELSE 'NEUTRAL' END AS label FROM {outcomes}",
    "c02_score_bins": f"SELECT strategy, bin, n, round(mean_score, 6) AS mean_score, round(rate, 6) AS rate, round(mean_score - rate, 6) AS gap, round(mean_return, 4) AS mean_return FROM ({_BINS}) q",
    "c04_calibration_metrics": f"SELECT strategy, round(sum(n * abs(mean_score - rate)) / nullif(sum(n), 0), 6) AS ece, round(max(abs(mean_score - rate)), 6) AS mce FROM ({_BINS}) q GROUP BY strategy",
    "c04_brier_and_rates": "SELECT strategy, round(avg((score / 100 - hit) * (score / 100 - hit)), 6) AS brier, round(count_if(score >= 50 AND hit = 1) / nullif(count_if(score >= 50), 0), 6) AS precision_50, round(count_if(score >= 50 AND hit = 1) / nullif(count_if(hit = 1), 0), 6) AS recall_50, round(count_if(score >= 50 AND hit = 0) / nullif(count_if(hit = 0), 0), 6) AS fpr_50 FROM {outcomes} GROUP BY strategy",
    "c06_threshold_sweep": "SELECT strategy, cut, n, round(hit_rate, 6) AS hit_rate, round(hit_rate * mean_return * sqrt(n), 6) AS quality, row_number() OVER (PARTITION BY strategy ORDER BY round(hit_rate * mean_return * sqrt(n), 9) DESC, cut) AS place FROM (SELECT strategy, cut, count(*) AS n, avg(hit) AS hit_rate, avg(net_return) AS mean_return FROM {outcomes} CROSS JOIN (VALUES (30), (35), (40), (45), (50), (55), (60), (65), (70), (75), (80), (85), (90)) AS t(cut) WHERE score >= cut GROUP BY strategy, cut) q",
    "c07_calibrated_scores": f"SELECT o.signal_id, round(100 * b.rate, 6) AS calibrated FROM {{outcomes}} o JOIN ({_BINS}) b ON o.strategy = b.strategy AND b.bin = CAST(least(floor(o.score / 10), 9) AS INT)",
    "c08_cohorts": "SELECT field, value, n, round(rate, 6) AS rate, round(gap, 6) AS gap, CASE WHEN rate < 0.4 OR gap < -0.2 THEN 1 ELSE 0 END AS weak FROM (SELECT field, value, count(*) AS n, avg(hit) AS rate, avg(hit - score / 100) AS gap FROM (SELECT 'strategy' AS field, strategy AS value, hit, score FROM {outcomes} UNION ALL SELECT 'cohort', cohort, hit, score FROM {outcomes}) u GROUP BY field, value) q",
    "c10_reliability_curve": f"SELECT strategy, bin, n, round(rate, 6) AS rate, CASE WHEN abs(mean_score - rate) <= 0.05 THEN 'WELL' WHEN mean_score > rate THEN 'OVER' ELSE 'UNDER' END AS class FROM ({_BINS}) q WHERE n >= 5",
    "d04_shifts": f"SELECT round(avg(CASE WHEN side = 'cur' THEN x END) - avg(CASE WHEN side = 'ref' THEN x END), 6) AS mean_shift, round(stddev_pop(CASE WHEN side = 'cur' THEN x END) - stddev_pop(CASE WHEN side = 'ref' THEN x END), 6) AS std_shift, round(exact_percentile(CASE WHEN side = 'cur' THEN x END, 0.9) - exact_percentile(CASE WHEN side = 'ref' THEN x END, 0.9), 6) AS p90_shift FROM ({_SIDES}) q",
    "d05_categorical_drift": "SELECT cohort, round(p, 6) AS p, round(q, 6) AS q, CASE WHEN abs(p - q) > 0.1 THEN 'HIGH' WHEN abs(p - q) > 0.03 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM (SELECT cohort, count_if(ts < DATE '1997-01-01') / (sum(count_if(ts < DATE '1997-01-01')) OVER () + 0.0) AS p, count_if(ts >= DATE '1997-01-01') / (sum(count_if(ts >= DATE '1997-01-01')) OVER () + 0.0) AS q FROM {outcomes} GROUP BY cohort) w",
    "d07_prediction_drift": f"SELECT strategy, round(b - a, 6) AS rate_change, CASE WHEN abs(b - a) > 0.1 THEN 'DRIFT' ELSE 'STABLE' END AS status FROM ({_shift('alert_rate')}) q",
    "d08_signal_decay": f"SELECT strategy, round(a, 6) AS ref_hit, round(b, 6) AS cur_hit, round(b - a, 6) AS change FROM ({_shift('hit_rate')}) q",
    "d09_strategy_decay": f"SELECT strategy, round(greatest(0, least(100, 100 * (a - b) / nullif(abs(a), 0))), 4) AS decay_score FROM ({_shift('mean_return')}) q",
    "d10_metric_decay": f"SELECT strategy, CASE WHEN n < 30 THEN 'LOW_SAMPLE' WHEN (a - b) / nullif(a, 0) > 0.15 THEN 'DEGRADED' WHEN (a - b) / nullif(a, 0) > 0.05 THEN 'WATCH' ELSE 'OK' END AS status FROM ({_shift('hit_rate')}) q",
    "d11_champion_challenger": f"SELECT a.strategy AS champion, b.strategy AS challenger, CASE WHEN b.mean_return > a.mean_return * 1.05 AND b.hit_rate >= a.hit_rate THEN 'PROMOTE' WHEN b.mean_return < a.mean_return THEN 'KEEP' ELSE 'WATCH' END AS decision FROM ({_LEDGER}) a JOIN ({_LEDGER}) b ON a.strategy < b.strategy",
    "e01_ensemble_vote": f"SELECT symbol, round(long_w, 6) AS long_weight, round(short_w, 6) AS short_weight, round(greatest(long_w, short_w) / nullif(total, 0), 6) AS agreement, CASE WHEN long_w > 1.5 * short_w THEN 'LONG' WHEN short_w > 1.5 * long_w THEN 'SHORT' ELSE 'NEUTRAL' END AS direction FROM (SELECT symbol, sum(CASE WHEN direction = 'LONG' THEN weight * score / 100 ELSE 0 END) AS long_w, sum(CASE WHEN direction = 'SHORT' THEN weight * score / 100 ELSE 0 END) AS short_w, sum(weight * score / 100) AS total FROM ({_VOTES}) v GROUP BY symbol) q",
    "e02_vote_weights": f"SELECT symbol, source, round(sum(weight) / nullif(sum(sum(weight)) OVER (PARTITION BY symbol), 0), 9) AS share FROM ({_VOTES}) v GROUP BY symbol, source",
    "e03_vote_conflicts": f"SELECT symbol, CASE WHEN t_long AND f_short OR t_short AND f_long THEN 1 ELSE 0 END AS technical_vs_fundamental, CASE WHEN t_long AND t_short THEN 1 ELSE 0 END AS directional FROM (SELECT symbol, bool_or(source = 'technical' AND direction = 'LONG') AS t_long, bool_or(source = 'technical' AND direction = 'SHORT') AS t_short, bool_or(source = 'fundamental' AND direction = 'LONG') AS f_long, bool_or(source = 'fundamental' AND direction = 'SHORT') AS f_short FROM ({_VOTES}) v GROUP BY symbol) q",
    "e04_context_layers": f"SELECT symbol, round(avg(layer), 6) AS base_score, CASE WHEN max(layer) - min(layer) > 60 THEN 'CONFLICT' ELSE 'ALIGNED' END AS status FROM (SELECT symbol, source, 100 * avg(CASE direction WHEN 'LONG' THEN 1.0 WHEN 'SHORT' THEN 0.0 ELSE 0.5 END) AS layer FROM ({_VOTES}) v GROUP BY symbol, source) q GROUP BY symbol",
    "e05_leaderboard": f"SELECT strategy, round(raw, 6) AS score, row_number() OVER (ORDER BY round(raw, 9) DESC, strategy) AS place FROM (SELECT strategy, 0.5 * 100 * hit_rate + 0.5 * greatest(0, least(100, 50 + mean_return * 5)) - CASE WHEN n < 30 THEN 20 ELSE 0 END AS raw FROM ({_LEDGER}) l) q",
    "e07_blend_scores": "SELECT signal_id, round(0.7 * score + 0.3 * 100 / (1 + exp(-net_return / 5)), 6) AS blended FROM {outcomes}",
    "e08_adaptive_scores": "SELECT strategy, cohort, round(50 + greatest(-50, least(50, avg(net_return) * 5)), 6) AS adaptive, round(least(1, count(*) / 100.0), 6) AS confidence FROM {outcomes} GROUP BY strategy, cohort",
    "e09_review_priority": "SELECT signal_id, CASE WHEN score >= 60 AND hit = 0 THEN 3 WHEN net_return < -1 THEN 2 WHEN score BETWEEN 40 AND 60 THEN 1 ELSE 0 END AS priority FROM {outcomes}",
    "e10_scorecard": f"SELECT strategy, round(s, 4) AS score, CASE WHEN s >= 60 THEN 'GREEN' WHEN s >= 40 THEN 'AMBER' ELSE 'RED' END AS band FROM (SELECT strategy, 0.4 * 100 * hit_rate + 0.4 * greatest(0, least(100, 50 + 5 * mean_return)) + 0.2 * least(100, n / 10.0) AS s FROM ({_LEDGER}) l) q",
}

STATEMENTS = {n: Statement(text, S) for n, text in TEXTS.items()}
