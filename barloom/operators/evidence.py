"""Risk shares, drift, peer valuation, error classes and model metrics, each with a check written on its own."""

from __future__ import annotations

from barloom.operators.alignment import S as BASE
from barloom.operators.performance import _STAKES
from barloom.plans.statements import Statement
from barloom.sources.bars import BARS
from barloom.sources.tables import BREADTH, INSTRUMENTS, OUTCOMES, derived

#: Outcomes on both sides of a day.
SIDES = derived("SELECT strategy, score AS x, net_return, CASE WHEN ts < DATE '1997-01-01' THEN 'ref' ELSE 'cur' END AS side FROM {outcomes}", outcomes=OUTCOMES)
#: A quarter's multiples of a symbol with its sector.
MULTIPLES = derived(
    "SELECT r.symbol, i.sector, r.period, extract(year FROM r.period) AS fiscal_year, r.revenue, r.profit, i.size * 100 + 2000000 AS cap, CASE WHEN r.profit > 0 THEN (i.size * 100 + 2000000) / r.profit END AS pe, (i.size * 100 + 2000000) / nullif(r.revenue, 0) AS ps FROM {reports} r JOIN {instruments} i ON r.symbol = i.symbol",
    reports=BASE["reports"], instruments=INSTRUMENTS,
)
S = BASE | {"sides": SIDES, "multiples": MULTIPLES, "bars": BARS, "breadth": BREADTH}

# A portfolio's daily return is sum(w r); a symbol without a bar on a day returns 0. The covariance of each symbol with the
# portfolio then needs no pairs: its share of the variance is w cov(r, portfolio).
_STAKED = f"SELECT x.symbol, x.ts, x.r, p.weight FROM {{returns}} x JOIN ({_STAKES}) p ON x.symbol = p.symbol"
_BASKET = f"SELECT ts, sum(weight * r) AS total FROM ({_STAKED}) s GROUP BY ts"
_RISK = f"SELECT s.symbol, max(s.weight) AS weight, (sum(s.r * b.total) - sum(s.r) * max(m.total) / max(m.days)) / (max(m.days) - 1) AS cov, max(m.variance) AS variance FROM ({_STAKED}) s JOIN ({_BASKET}) b ON s.ts = b.ts CROSS JOIN (SELECT count(*) AS days, sum(total) AS total, var_samp(total) AS variance FROM ({_BASKET}) t) m GROUP BY s.symbol"

# Counts by distinct value inside buckets of values, and the counts of all buckets before: no window over a whole table.
_VALUES = "SELECT CAST(floor(x) AS BIGINT) AS bucket, x, count_if(side = 'ref') AS nr, count_if(side = 'cur') AS nc FROM {sides} GROUP BY x"
_BUCKETS = f"SELECT bucket, sum(sum(nr)) OVER (ORDER BY bucket) - sum(nr) AS r0, sum(sum(nc)) OVER (ORDER BY bucket) - sum(nc) AS c0, sum(sum(nr)) OVER () AS rn, sum(sum(nc)) OVER () AS cn, lead(min(x)) OVER (ORDER BY bucket) AS next_x FROM ({_VALUES}) v GROUP BY bucket"
_CDF = f"SELECT v.x, (r0 + sum(nr) OVER w) / rn AS fr, (c0 + sum(nc) OVER w) / cn AS fc, coalesce(lead(v.x) OVER (PARTITION BY v.bucket ORDER BY v.x), next_x) - v.x AS gap FROM ({_VALUES}) v JOIN ({_BUCKETS}) b ON v.bucket = b.bucket WINDOW w AS (PARTITION BY v.bucket ORDER BY v.x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DUCK_CDF = "SELECT x, (SELECT count(*) FROM {sides} r WHERE r.side = 'ref' AND r.x <= d.x) / (SELECT count(*) FROM {sides} WHERE side = 'ref') AS fr, (SELECT count(*) FROM {sides} r WHERE r.side = 'cur' AND r.x <= d.x) / (SELECT count(*) FROM {sides} WHERE side = 'cur') AS fc, lead(x) OVER (ORDER BY x) - x AS gap FROM (SELECT DISTINCT x FROM {sides}) d"

_RANKED = "SELECT *, row_number() OVER (PARTITION BY sector, period ORDER BY pe, symbol) AS k, rank() OVER (PARTITION BY sector, period ORDER BY pe) AS below, count(*) OVER (PARTITION BY sector, period) AS n FROM {multiples} WHERE pe IS NOT NULL"
# The median of the others: the middle of the sorted list, one place on where the row itself stands before it.
_MIDDLES = f"SELECT sector, period, max(CASE WHEN k = n DIV 2 THEN pe END) AS a, max(CASE WHEN k = n DIV 2 + 1 THEN pe END) AS b, max(CASE WHEN k = n DIV 2 + 2 THEN pe END) AS c FROM ({_RANKED}) r GROUP BY sector, period"
_OTHERS = f"SELECT r.*, CASE WHEN n < 2 THEN NULL WHEN n % 2 = 0 THEN CASE WHEN k <= n DIV 2 THEN b ELSE a END ELSE CASE WHEN k <= n DIV 2 THEN (b + c) / 2 WHEN k = n DIV 2 + 1 THEN (a + c) / 2 ELSE (a + b) / 2 END END AS peer_median FROM ({_RANKED}) r JOIN ({_MIDDLES}) m ON r.sector = m.sector AND r.period = m.period"
_CLASS = "CASE WHEN premium <= -0.2 THEN 'DISCOUNT' WHEN premium >= 0.2 THEN 'PREMIUM' ELSE 'INLINE' END"
_MARGINS = "SELECT symbol, sector, fiscal_year, sum(profit) / nullif(sum(revenue), 0) AS margin FROM {multiples} GROUP BY symbol, sector, fiscal_year"
_MID = f"SELECT sector, fiscal_year, percentile(margin, 0.5) AS mid FROM ({_MARGINS}) m GROUP BY sector, fiscal_year"
_STANDING = "CASE WHEN q.margin > 1.2 * s.mid THEN 'STRENGTH' WHEN q.margin < 0.8 * s.mid THEN 'WEAKNESS' ELSE 'INLINE' END"
_ERRORS = "array_compact(array(CASE WHEN score >= 60 AND hit = 0 THEN 'OVERCONFIDENT' END, CASE WHEN score < 30 AND hit = 1 THEN 'MISSED' END, CASE WHEN hit = 1 AND net_return < 0 THEN 'COST_DRAG' END, CASE WHEN abs(score - 50) < 5 AND abs(net_return) >= 2 THEN 'NO_VIEW' END))"

_BY_SCORE = "SELECT strategy, score, count_if(hit = 1) AS p, count_if(hit = 0) AS n FROM {outcomes} GROUP BY strategy, score"
_PREDICTED = "SELECT hit, score >= 50 AS yes, net_return AS y, (score - 50) / 10 AS f FROM {outcomes}"

#: name: (statement, its check)
PAIRS = {
    "b16_risk_contribution": (
        f"SELECT symbol, round(weight, 9) AS weight, round(weight * cov / sqrt(variance), 9) AS contribution, round(weight * cov / variance, 9) AS share, round(sqrt(variance), 9) AS portfolio_volatility FROM ({_RISK}) q",
        f"WITH p AS MATERIALIZED ({_STAKES}), x AS MATERIALIZED (SELECT symbol, ts, r FROM {{returns}} WHERE symbol IN (SELECT symbol FROM p)), g AS MATERIALIZED (SELECT p.symbol, p.weight, d.ts, coalesce(x.r, 0) AS r FROM p CROSS JOIN (SELECT DISTINCT ts FROM x) d LEFT JOIN x ON x.symbol = p.symbol AND x.ts = d.ts), c AS (SELECT a.symbol AS i, any_value(a.weight) * any_value(b.weight) * covar_samp(a.r, b.r) AS v FROM g a JOIN g b ON a.ts = b.ts GROUP BY a.symbol, b.symbol), t AS (SELECT i, sum(v) AS v FROM c GROUP BY i) SELECT t.i AS symbol, round(p.weight, 9) AS weight, round(t.v / sqrt(sum(t.v) OVER ()), 9) AS contribution, round(t.v / sum(t.v) OVER (), 9) AS share, round(sqrt(sum(t.v) OVER ()), 9) AS portfolio_volatility FROM t JOIN p ON p.symbol = t.i"),
    "d01_psi": (
        "SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM (SELECT r / sum(r) OVER () AS p, c / sum(c) OVER () AS q FROM (SELECT b.bin, coalesce(max(k.nr), 0) / max(t.rn) + 0.0001 AS r, coalesce(max(k.nc), 0) / max(t.cn) + 0.0001 AS c FROM (SELECT explode(sequence(0, 9)) AS bin) b LEFT JOIN (SELECT aggregate(sequence(1, 9), 0, (a, i) -> a + CASE WHEN x >= low + (high - low) * i / 10 THEN 1 ELSE 0 END) AS bin, count_if(side = 'ref') AS nr, count_if(side = 'cur') AS nc FROM {sides} s CROSS JOIN (SELECT min(x) AS low, max(x) AS high FROM {sides}) g GROUP BY 1) k ON b.bin = k.bin CROSS JOIN (SELECT count_if(side = 'ref') AS rn, count_if(side = 'cur') AS cn FROM {sides}) t GROUP BY b.bin) e) f",
        "WITH e AS (SELECT min(x) + (max(x) - min(x)) * i / 10 AS low, min(x) + (max(x) - min(x)) * (i + 1) / 10 AS high, i FROM {sides}, range(10) r(i) GROUP BY i), h AS (SELECT i, count(x) FILTER (side = 'ref') AS r, count(x) FILTER (side = 'cur') AS c FROM e LEFT JOIN {sides} ON x >= low AND (x < high OR i = 9) GROUP BY i), f AS (SELECT r / sum(r) OVER () + 1e-4 AS r, c / sum(c) OVER () + 1e-4 AS c FROM h) SELECT round(sum((c / cs - r / rs) * ln((c / cs) / (r / rs))), 6) AS psi FROM f, (SELECT sum(r) AS rs, sum(c) AS cs FROM f)"),
    "d02_ks": (f"SELECT round(max(abs(fr - fc)), 6) AS ks FROM ({_CDF}) q", f"SELECT round(max(abs(fr - fc)), 6) AS ks FROM ({_DUCK_CDF})"),
    "d03_wasserstein": (f"SELECT round(sum(abs(fr - fc) * gap), 6) AS wasserstein FROM ({_CDF}) q", f"SELECT round(sum(abs(fr - fc) * gap), 6) AS wasserstein FROM ({_DUCK_CDF})"),
    "d06_frame_drift": (
        "SELECT feature, round((mc - mr) / nullif(sr, 0), 6) AS mean_z, round(vc / nullif(vr, 0), 6) AS variance_ratio, round(100 * (gc - gr), 6) AS missing_points, abs((mc - mr) / nullif(sr, 0)) > 2 OR vc / nullif(vr, 0) > 2 OR gc - gr > 0.1 AS drifted FROM (SELECT feature, avg(CASE WHEN side = 'ref' THEN v END) AS mr, avg(CASE WHEN side = 'cur' THEN v END) AS mc, stddev_samp(CASE WHEN side = 'ref' THEN v END) AS sr, var_samp(CASE WHEN side = 'ref' THEN v END) AS vr, var_samp(CASE WHEN side = 'cur' THEN v END) AS vc, avg(CASE WHEN side = 'ref' THEN CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END END) AS gr, avg(CASE WHEN side = 'cur' THEN CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END END) AS gc FROM (SELECT side, stack(3, 'score', x, 'net_return', net_return, 'late_return', CASE WHEN side = 'ref' OR net_return > 1 THEN net_return * 2 END) AS (feature, v) FROM {sides}) u GROUP BY feature) q",
        "WITH u AS (SELECT 'score' AS feature, side, x AS v FROM {sides} UNION ALL SELECT 'net_return', side, net_return FROM {sides} UNION ALL SELECT 'late_return', side, if(side = 'ref' OR net_return > 1, net_return * 2, NULL) FROM {sides}), a AS (SELECT feature, side, avg(v) AS m, var_samp(v) AS s, 1 - count(v) / count(*) AS g FROM u GROUP BY ALL) SELECT c.feature, round((c.m - r.m) / sqrt(r.s), 6) AS mean_z, round(c.s / r.s, 6) AS variance_ratio, round(100 * (c.g - r.g), 6) AS missing_points, abs(c.m - r.m) > 2 * sqrt(r.s) OR c.s > 2 * r.s OR c.g - r.g > 0.1 AS drifted FROM a c JOIN a r ON c.feature = r.feature AND c.side = 'cur' AND r.side = 'ref'"),
    "a17_peer_comparison": (
        f"SELECT symbol, period, round(peer_median, 6) AS median_pe, round(100 * premium, 6) AS premium_pct, round(100.0 * below / n, 6) AS percentile, {_CLASS} AS class FROM (SELECT *, pe / nullif(peer_median, 0) - 1 AS premium FROM ({_OTHERS}) o) q WHERE n >= 3",
        f"WITH m AS MATERIALIZED (SELECT * FROM {{multiples}} WHERE pe IS NOT NULL), j AS (SELECT a.symbol, a.period, any_value(a.pe) AS pe, median(b.pe) AS peer, count(*) FILTER (b.pe < a.pe) AS lower, count(*) AS others FROM m a JOIN m b ON a.sector = b.sector AND a.period = b.period AND a.symbol <> b.symbol GROUP BY a.symbol, a.period) SELECT symbol, period, round(peer, 6) AS median_pe, round(100 * premium, 6) AS premium_pct, round(100.0 * (lower + 1) / (others + 1), 6) AS percentile, {_CLASS} AS class FROM (SELECT *, pe / peer - 1 AS premium FROM j) WHERE others >= 2"),
    "a18_valuation_score": (
        "SELECT symbol, period, round(aggregate(filter(parts, p -> p.v IS NOT NULL), CAST(0 AS DOUBLE), (a, p) -> a + p.w * p.v) / nullif(aggregate(filter(parts, p -> p.v IS NOT NULL), CAST(0 AS DOUBLE), (a, p) -> a + p.w), 0), 6) AS score, CASE WHEN pe IS NULL THEN 'NO_EARNINGS' WHEN pe > 40 OR ps > 15 THEN 'EXPENSIVE' ELSE 'FAIR' END AS risk FROM (SELECT *, array(named_struct('w', 0.6, 'v', CASE WHEN pe IS NOT NULL THEN 100 * (1 - least(pe / 50, 1)) END), named_struct('w', 0.4, 'v', CASE WHEN ps IS NOT NULL THEN 100 * (1 - least(ps / 20, 1)) END)) AS parts FROM {multiples}) q",
        "SELECT symbol, period, round(CASE WHEN pe IS NULL THEN b WHEN ps IS NULL THEN a ELSE 0.6 * a + 0.4 * b END, 6) AS score, CASE WHEN pe > 40 OR (pe IS NOT NULL AND ps > 15) THEN 'EXPENSIVE' WHEN pe IS NULL THEN 'NO_EARNINGS' ELSE 'FAIR' END AS risk FROM (SELECT *, 100 - 2 * least(pe, 50) AS a, 100 - 5 * least(ps, 20) AS b FROM {multiples})"),
    "a20_sector_medians": (
        f"SELECT q.symbol, q.fiscal_year, q.sector, round(s.mid, 9) AS sector_median, round(100 * cume_dist() OVER (PARTITION BY q.sector, q.fiscal_year ORDER BY q.margin), 6) AS percentile, {_STANDING} AS class FROM ({_MARGINS}) q JOIN ({_MID}) s ON q.sector = s.sector AND q.fiscal_year = s.fiscal_year",
        f"WITH q AS MATERIALIZED ({_MARGINS}) SELECT q.symbol, q.fiscal_year, q.sector, round(s.mid, 9) AS sector_median, round(100.0 * (SELECT count(*) FROM q z WHERE z.sector = q.sector AND z.fiscal_year = q.fiscal_year AND z.margin <= q.margin) / s.n, 6) AS percentile, {_STANDING} AS class FROM q JOIN (SELECT sector, fiscal_year, median(margin) AS mid, count(*) AS n FROM q GROUP BY ALL) s USING (sector, fiscal_year)"),
    "c09_error_taxonomy": (
        f"SELECT error, CASE error WHEN 'OVERCONFIDENT' THEN 'HIGH' WHEN 'MISSED' THEN 'MEDIUM' WHEN 'NONE' THEN 'NONE' ELSE 'LOW' END AS severity, count(*) AS n FROM (SELECT explode(CASE WHEN size(errors) = 0 THEN array('NONE') ELSE errors END) AS error FROM (SELECT {_ERRORS} AS errors FROM {{outcomes}}) e) q GROUP BY error",
        "WITH a AS (SELECT score >= 60 AND hit = 0 AS o, score < 30 AND hit = 1 AS m, hit = 1 AND net_return < 0 AS c, score > 45 AND score < 55 AND (net_return >= 2 OR net_return <= -2) AS v FROM {outcomes}), t AS (SELECT 'OVERCONFIDENT' AS error, 'HIGH' AS severity, count(*) FILTER (o) AS n FROM a UNION ALL SELECT 'MISSED', 'MEDIUM', count(*) FILTER (m) FROM a UNION ALL SELECT 'COST_DRAG', 'LOW', count(*) FILTER (c) FROM a UNION ALL SELECT 'NO_VIEW', 'LOW', count(*) FILTER (v) FROM a UNION ALL SELECT 'NONE', 'NONE', count(*) FILTER (NOT (o OR m OR c OR v)) FROM a) SELECT * FROM t WHERE n > 0"),
    "c05_auc": (
        f"SELECT strategy, round(sum(p * (lower + n / 2.0)) / nullif(sum(p) * CAST(sum(n) AS DOUBLE), 0), 6) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY strategy ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM ({_BY_SCORE}) h) q GROUP BY strategy",
        "SELECT strategy, round((sum(place) FILTER (hit = 1) - count(*) FILTER (hit = 1) * (count(*) FILTER (hit = 1) + 1) / 2) / (count(*) FILTER (hit = 1) * count(*) FILTER (hit = 0)), 6) AS auc FROM (SELECT strategy, hit, rank() OVER (PARTITION BY strategy ORDER BY score) + (count(*) OVER (PARTITION BY strategy, score) - 1) / 2 AS place FROM {outcomes}) GROUP BY strategy"),
    "m07_metrics": (
        f"SELECT round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision_, round(tp / nullif(tp + fn, 0), 6) AS recall_, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(mae, 6) AS mae, round(sqrt(mse), 6) AS rmse, round(1 - mse / nullif(variance, 0), 6) AS r2, round(aligned, 6) AS directional FROM (SELECT count(*) AS n, count_if(yes AND hit = 1) AS tp, count_if(NOT yes AND hit = 0) AS tn, count_if(yes AND hit = 0) AS fp, count_if(NOT yes AND hit = 1) AS fn, avg(abs(y - f)) AS mae, avg((y - f) * (y - f)) AS mse, var_pop(y) AS variance, avg(CASE WHEN sign(y) = sign(f) THEN 1.0 ELSE 0.0 END) AS aligned FROM ({_PREDICTED}) p) q",
        f"WITH p AS ({_PREDICTED}), k AS (SELECT hit, yes, count(*) AS c FROM p GROUP BY ALL), t AS (SELECT sum(c) AS n, sum(c) FILTER (hit = 1) AS real_, sum(c) FILTER (yes) AS said, sum(c) FILTER (yes AND hit = 1) AS both_, sum(c) FILTER (yes = (hit = 1)) AS ok FROM k), e AS (SELECT avg(abs(y - f)) AS mae, sum((y - f) ^ 2) AS sse, sum((y - (SELECT avg(y) FROM p)) ^ 2) AS sst, count(*) AS n, count(*) FILTER ((y > 0 AND f > 0) OR (y < 0 AND f < 0) OR (y = 0 AND f = 0)) AS same FROM p) SELECT round(ok / t.n, 6) AS accuracy, round(both_ / said, 6) AS precision_, round(both_ / real_, 6) AS recall_, round(2 / (said / both_ + real_ / both_), 6) AS f1, round(mae, 6) AS mae, round(sqrt(sse / e.n), 6) AS rmse, round(1 - sse / sst, 6) AS r2, round(same / e.n, 6) AS directional FROM t, e"),
}
STATEMENTS = {n: Statement(text, S, oracle=check) for n, (text, check) in PAIRS.items()}
