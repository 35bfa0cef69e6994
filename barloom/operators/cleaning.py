"""Cleaning of market tables: bars with faults, the rules that mend or drop them, reports on what they did.

Faulty bars are the given ones with planted faults, one in fifty of each kind. Each statement has a check of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.operators.evidence import S as BASE
from barloom.plans.layers import Source, spark_text
from barloom.plans.statements import Statement, table
from barloom.sources.bars import BARS, bars
from barloom.sources.tables import derived

_FAULT = "(symbol * 31 + day_number(ts)) % 50"
_SPOILT = {
    "open": f"CASE {_FAULT} WHEN 1 THEN NULL ELSE open END", "high": f"CASE {_FAULT} WHEN 1 THEN NULL WHEN 2 THEN low - 1 ELSE high END", "low": f"CASE {_FAULT} WHEN 1 THEN NULL ELSE low END",
    "close": f"CASE {_FAULT} WHEN 1 THEN NULL WHEN 3 THEN -close WHEN 4 THEN 0.0 WHEN 5 THEN NULL WHEN 8 THEN close * 30 ELSE close END", "volume": f"CASE {_FAULT} WHEN 1 THEN NULL WHEN 6 THEN -volume ELSE volume END",
}
_TWICE = f"{_FAULT} IN (3, 7)"


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In one pass over the bars: a union of two would forget that they lie by symbol, and be shuffled once more into
    partitions that do not grow with the table."""
    first, again = (f"named_struct('place', {place}, {', '.join(f"'{c}', {v}" for c, v in values.items())})" for place, values in ((1, _SPOILT), (2, {c: c for c in _SPOILT} | {"close": "close + 1"})))
    return bars(spark, sf_dir).selectExpr("symbol", "ts", spark_text(f"inline(CASE WHEN {_TWICE} THEN array({first}, {again}) ELSE array({first}) END)"))


#: place: 1 for a bar as it came, 2 for a later one of the same stamp.
FAULTY = Source(_faulty, derived(
    f"SELECT symbol, ts, 1 AS place, {', '.join(f'{v} AS {c}' for c, v in _SPOILT.items())} FROM {{bars}} "
    f"UNION ALL SELECT symbol, ts, 2, open, high, low, close + 1, volume FROM {{bars}} WHERE {_TWICE}",
    bars=BARS,
).sql)
#: A table as it was typed: stamps in three forms, symbols and names with stray signs.
TYPED = derived(
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) WHEN 1 THEN lpad(CAST(extract(day FROM o_orderdate) AS VARCHAR(2)), 2, '0') || '.' || lpad(CAST(extract(month FROM o_orderdate) AS VARCHAR(2)), 2, '0') || '.' || CAST(extract(year FROM o_orderdate) AS VARCHAR(4)) WHEN 2 THEN CAST(extract(year FROM o_orderdate) AS VARCHAR(4)) || '/' || lpad(CAST(extract(month FROM o_orderdate) AS VARCHAR(2)), 2, '0') || '/' || lpad(CAST(extract(day FROM o_orderdate) AS VARCHAR(2)), 2, '0') ELSE 'n/a' END AS day, ' tick' || CAST(o_custkey AS VARCHAR(20)) || '.is ' AS symbol, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '  ' || o_orderpriority || '   x ' END AS note FROM {orders}",
    orders=table("orders", "o_orderkey, o_orderdate, o_custkey, o_orderpriority"),
)
S = BASE | {"faulty": FAULTY, "typed": TYPED}

_DATED = "coalesce(try_to_date(day, 'yyyy-MM-dd'), try_to_date(day, 'dd.MM.yyyy'), try_to_date(day, 'yyyy/MM/dd'))"
_NORMAL = f"SELECT o_orderkey, {_DATED} AS day, regexp_replace(upper(trim(symbol)), '[.]IS$', '') AS symbol, nullif(trim(regexp_replace(note, ' +', ' ')), '') AS note FROM {{typed}}"
_DUCK_NORMAL = "SELECT o_orderkey, CAST(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%d.%m.%Y'), try_strptime(day, '%Y/%m/%d')) AS DATE) AS day, replace(upper(trim(symbol)), '.IS', '') AS symbol, CASE WHEN note <> '' THEN array_to_string(list_filter(string_split(note, ' '), lambda x: x <> ''), ' ') END AS note FROM {typed}"

_EMPTY = "coalesce(open, high, low, close, volume) IS NULL"
_NEGATIVE = "least(open, high, low, close, volume) < 0"
_ZERO = "close = 0"
_BAD = "high < greatest(open, low, close) OR low > least(open, high, close)"
# One pass over the symbol's rows in order: each row takes the first rule that it breaks, as the rules stand in a chain.
_JUDGED = f"SELECT *, CASE WHEN place < max(place) OVER (PARTITION BY symbol, ts) THEN 'DUPLICATE' WHEN {_EMPTY} THEN 'EMPTY' WHEN {_NEGATIVE} THEN 'NEGATIVE' WHEN {_ZERO} THEN 'ZERO' WHEN close IS NOT NULL AND close <= 20 * high AND ({_BAD}) THEN 'OHLC' ELSE 'KEPT' END AS verdict FROM {{faulty}}"
_FILLED = f"SELECT *, coalesce(close, last_value(close) IGNORE NULLS OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS filled FROM ({_JUDGED}) j WHERE verdict = 'KEPT'"
_CLEAN = f"SELECT symbol, ts, filled AS close, close IS NULL AS was_missing, coalesce(abs(filled / lag(filled) OVER (PARTITION BY symbol ORDER BY ts) - 1) > 10, FALSE) AS outlier FROM ({_FILLED}) f"

_D1 = "SELECT * FROM {faulty} QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY place DESC) = 1"
_D2 = f"SELECT * FROM ({_D1}) WHERE NOT (open IS NULL AND high IS NULL AND low IS NULL AND close IS NULL AND volume IS NULL)"
_D3 = f"SELECT * FROM ({_D2}) WHERE NOT (coalesce(close, 0) < 0 OR coalesce(volume, 0) < 0 OR coalesce(high, 0) < 0 OR coalesce(low, 0) < 0)"
_D4 = f"SELECT * FROM ({_D3}) WHERE close IS DISTINCT FROM 0"
_D5 = f"SELECT * FROM ({_D4}) WHERE close IS NULL OR close > 20 * high OR (high >= open AND high >= low AND high >= close AND low <= open AND low <= close)"
_D6 = f"SELECT a.symbol, a.ts, coalesce(a.close, b.close) AS close, a.close IS NULL AS was_missing FROM ({_D5}) a ASOF LEFT JOIN (SELECT symbol, ts, close FROM ({_D5}) WHERE close IS NOT NULL) b ON a.symbol = b.symbol AND a.ts >= b.ts"
_DUCK_CLEAN = f"SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) > 11, FALSE) AS outlier FROM ({_D6})"

_CHECKS = "count(*) AS n, count_if(place = 2) AS repeated, count_if(close IS NULL) AS missing, count_if(close < 0 OR volume < 0) AS negative, count_if(close = 0) AS zero, count_if(high < low) AS crossed"
_DUCK_CHECKS = "count(*) AS n, count(*) - count(DISTINCT ts) AS repeated, count(*) - count(close) AS missing, sum(CASE WHEN least(coalesce(close, 0), coalesce(volume, 0)) < 0 THEN 1 ELSE 0 END)::BIGINT AS negative, count(*) FILTER (close = 0) AS zero, count(*) FILTER (NOT low <= high) AS crossed"

#: name: (statement, its check)
PAIRS = {
    "p06_normalised_table": (_NORMAL, _DUCK_NORMAL),
    "p08_required_fields": (
        f"SELECT count(*) AS n, count_if(day IS NULL) AS no_day, count_if(note IS NULL) AS no_note, count_if(day IS NULL OR note IS NULL) AS dropped, count_if(day IS NOT NULL AND note IS NOT NULL) AS kept FROM ({_NORMAL}) q",
        "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 4 = 3) AS no_day, count(*) FILTER (o_orderkey % 9 = 0) AS no_note, count(*) FILTER (o_orderkey % 4 = 3 OR o_orderkey % 9 = 0) AS dropped, count(*) FILTER (o_orderkey % 4 <> 3 AND o_orderkey % 9 <> 0) AS kept FROM {typed}"),
    "p09_cleaned_bars": (_CLEAN, _DUCK_CLEAN),
    "p09_cleaning_report": (
        f"SELECT j.symbol, count(*) AS n, count_if(verdict = 'DUPLICATE') AS duplicates, count_if(verdict = 'EMPTY') AS empty_rows, count_if(verdict = 'NEGATIVE') AS negatives, count_if(verdict = 'ZERO') AS zeros, count_if(verdict = 'OHLC') AS bad_ohlc, count_if(verdict = 'KEPT' AND close IS NULL) AS filled, count_if(verdict = 'KEPT') AS kept FROM ({_JUDGED}) j GROUP BY j.symbol",
        "WITH " + ", ".join(f"d{k} AS ({t})" for k, t in enumerate((_D1, _D2, _D3, _D4, _D5), 1)) + ", c AS (" + " UNION ALL ".join(f"SELECT symbol, {k} AS step, count(*) AS n FROM {t} GROUP BY symbol" for k, t in enumerate(("{faulty}", "d1", "d2", "d3", "d4", "d5"))) + "), w AS (SELECT symbol, max(n) FILTER (step = 0) AS a, max(n) FILTER (step = 1) AS b, max(n) FILTER (step = 2) AS c, max(n) FILTER (step = 3) AS d, max(n) FILTER (step = 4) AS e, max(n) FILTER (step = 5) AS f FROM c GROUP BY symbol) SELECT symbol, a AS n, a - b AS duplicates, b - c AS empty_rows, c - d AS negatives, d - e AS zeros, e - f AS bad_ohlc, (SELECT count(*) FROM d5 WHERE d5.symbol = w.symbol AND close IS NULL) AS filled, f AS kept FROM w"),
    "p10_duplicate_policies": (
        "SELECT symbol, ts, max_by(close, place) AS keep_last, min_by(close, place) AS keep_first, CASE WHEN count(*) = 1 THEN max(close) END AS drop_all, count(*) > 1 AS fails FROM {faulty} GROUP BY symbol, ts",
        "SELECT a.symbol, a.ts, CASE WHEN b.symbol IS NULL THEN a.close ELSE b.close END AS keep_last, a.close AS keep_first, CASE WHEN b.symbol IS NULL THEN a.close END AS drop_all, b.symbol IS NOT NULL AS fails FROM (SELECT * FROM {faulty} WHERE place = 1) a LEFT JOIN (SELECT * FROM {faulty} WHERE place = 2) b ON a.symbol = b.symbol AND a.ts = b.ts"),
    "p11_positive_rows": (
        "SELECT symbol, ts, place, close FROM {faulty} WHERE close > 0 AND volume > 0",
        "SELECT symbol, ts, place, close FROM {faulty} EXCEPT ALL SELECT symbol, ts, place, close FROM {faulty} WHERE close IS NULL OR volume IS NULL OR close <= 0 OR volume <= 0"),
    "p12_ohlc_relation": (
        "SELECT symbol, ts, place, NOT coalesce(high >= greatest(open, low, close) AND low <= least(open, high, close), FALSE) AS broken FROM {faulty} WHERE open IS NOT NULL",
        "SELECT symbol, ts, place, close IS NOT NULL AND (high < open OR high < low OR high < close OR low > open OR low > close) OR close IS NULL AND (high < low OR high < open OR low > open) AS broken FROM {faulty} WHERE open IS NOT NULL"),
    "a25_contract_score": (
        f"SELECT symbol, greatest(0, 100 - 20 * (CASE WHEN negative > 0 THEN 1 ELSE 0 END + CASE WHEN crossed > 0 THEN 1 ELSE 0 END) - 5 * (CASE WHEN missing > 0.02 * n THEN 1 ELSE 0 END + CASE WHEN repeated > 0.03 * n THEN 1 ELSE 0 END)) AS score, negative + crossed = 0 AS passes FROM (SELECT symbol, {_CHECKS} FROM {{faulty}} GROUP BY symbol) q",
        f"WITH q AS (SELECT symbol, {_DUCK_CHECKS} FROM {{faulty}} GROUP BY symbol) SELECT symbol, 100 - 20 * (list_count(list_filter([negative, crossed], lambda x: x > 0))) - 5 * ((missing * 50 > n)::INT + (repeated * 100 > 3 * n)::INT) AS score, negative = 0 AND crossed = 0 AS passes FROM q"),
    "a26_bar_quality": (
        f"SELECT symbol, n, repeated, missing, negative, zero, crossed, wide_gaps, CASE WHEN crossed > 0.02 * n THEN least(20, plain) ELSE plain END AS score FROM (SELECT *, greatest(0, 100 - 10 * (CASE WHEN negative > 0 THEN 1 ELSE 0 END + CASE WHEN zero > 0 THEN 1 ELSE 0 END + CASE WHEN crossed > 0 THEN 1 ELSE 0 END) - 2 * (CASE WHEN repeated > 0 THEN 1 ELSE 0 END + CASE WHEN missing > 0 THEN 1 ELSE 0 END + CASE WHEN wide_gaps > 0 THEN 1 ELSE 0 END)) AS plain FROM (SELECT symbol, {_CHECKS}, count_if(gap > 20) AS wide_gaps FROM (SELECT *, day_number(ts) - day_number(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, place)) AS gap FROM {{faulty}}) g GROUP BY symbol) q) s",
        f"WITH c AS (SELECT symbol, {_DUCK_CHECKS} FROM {{faulty}} GROUP BY symbol), g AS (SELECT symbol, count(*) FILTER (d > 20) AS wide_gaps FROM (SELECT symbol, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) - ts AS d FROM (SELECT DISTINCT symbol, ts FROM {{faulty}})) GROUP BY symbol), s AS (SELECT c.*, wide_gaps, 100 - 10 * list_count(list_filter([negative, zero, crossed], lambda x: x > 0)) - 2 * list_count(list_filter([repeated, missing, wide_gaps], lambda x: x > 0)) AS plain FROM c JOIN g USING (symbol)) SELECT symbol, n, repeated, missing, negative, zero, crossed, wide_gaps, CASE WHEN crossed * 50 > n AND plain > 20 THEN 20 ELSE plain END AS score FROM s"),
    "m02_leakage_checks": (
        "SELECT check_name, n FROM (SELECT 'out_of_order' AS check_name, count_if(ts < before) AS n FROM (SELECT ts, lag(ts) OVER (PARTITION BY symbol ORDER BY trade_id, ts) AS before FROM {trades}) a UNION ALL SELECT 'train_test_overlap', count(*) FROM (SELECT symbol FROM {outcomes} WHERE ts < DATE '1998-01-01' INTERSECT SELECT symbol FROM {outcomes} WHERE ts >= DATE '1998-01-01') b UNION ALL SELECT 'future_as_of', count_if(ts > DATE '2000-12-31') FROM {outcomes} UNION ALL SELECT 'label_among_features', count_if(corr_ > 0.999) FROM (SELECT strategy, corr(hit, CASE WHEN state = 'F' THEN 1.0 ELSE 0.0 END) AS corr_ FROM {outcomes} GROUP BY strategy) c) q",
        "SELECT 'out_of_order' AS check_name, (WITH k AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY trade_id, ts) AS k FROM {trades}) SELECT count(*) FROM k a JOIN k b ON a.symbol = b.symbol AND a.k = b.k + 1 WHERE a.ts < b.ts) AS n UNION ALL SELECT 'train_test_overlap', (SELECT count(*) FROM (SELECT symbol FROM {outcomes} GROUP BY symbol HAVING min(ts) < DATE '1998-01-01' AND max(ts) >= DATE '1998-01-01')) UNION ALL SELECT 'future_as_of', (SELECT count(*) FROM {outcomes} WHERE year(ts) > 2000) UNION ALL SELECT 'label_among_features', (SELECT count(DISTINCT strategy) FROM {outcomes} WHERE strategy NOT IN (SELECT strategy FROM {outcomes} WHERE (hit = 1) <> (state = 'F')))"),
    "u01_union_by_name": (
        "SELECT symbol, ts, max(close) AS close, max(revenue) AS revenue FROM (SELECT symbol, ts, close, CAST(NULL AS DOUBLE) AS revenue FROM {bars} UNION ALL SELECT symbol, period, CAST(NULL AS DOUBLE), round(revenue, 2) FROM {reports}) u GROUP BY symbol, ts",
        "SELECT coalesce(b.symbol, r.symbol) AS symbol, coalesce(b.ts, r.period) AS ts, b.close, round(r.revenue, 2) AS revenue FROM {bars} b FULL JOIN {reports} r ON b.symbol = r.symbol AND b.ts = r.period"),
    "j13_orphans": (
        "SELECT c.c_custkey AS symbol FROM {customer} c LEFT ANTI JOIN {events} e ON c.c_custkey = e.user_id",
        "SELECT c_custkey AS symbol FROM {customer} WHERE c_custkey NOT IN (SELECT user_id FROM {events} WHERE user_id IS NOT NULL)"),
    "u03_set_difference": (
        "SELECT symbol, layer FROM (SELECT symbol, explode(array('trades', 'events', 'orders')) AS layer FROM {instruments}) a EXCEPT SELECT symbol, layer FROM (SELECT symbol, 'trades' AS layer FROM {trades} UNION ALL SELECT user_id, 'events' FROM {events} WHERE event_type = 'error' AND value > 50 UNION ALL SELECT o_custkey, 'orders' FROM {orders} WHERE o_orderstatus = 'P') b",
        "SELECT i.symbol, l.layer FROM {instruments} i, (VALUES ('trades'), ('events'), ('orders')) l(layer) WHERE NOT CASE layer WHEN 'trades' THEN EXISTS (SELECT 1 FROM {trades} t WHERE t.symbol = i.symbol) WHEN 'events' THEN EXISTS (SELECT 1 FROM {events} e WHERE e.user_id = i.symbol AND e.event_type = 'error' AND e.value > 50) ELSE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = i.symbol AND o.o_orderstatus = 'P') END"),
    "x07_freshness": (
        "SELECT symbol, max(ts) AS newest, day_number(max(m.last_day)) - day_number(max(ts)) AS age_days, day_number(max(m.last_day)) - day_number(max(ts)) > 5 AS stale FROM {bars} CROSS JOIN (SELECT max(CAST(l_shipdate AS DATE)) AS last_day FROM {lineitem}) m GROUP BY symbol",
        "SELECT symbol, newest, max(newest) OVER () - newest AS age_days, max(newest) OVER () - newest > 5 AS stale FROM (SELECT symbol, max(ts) AS newest FROM {bars} GROUP BY symbol)"),
    "f01_normalised_text": (
        r"SELECT doc_id, md5(plain) AS digest, length(plain) AS n_chars FROM (SELECT doc_id, trim(regexp_replace(lower(translate(regexp_replace(coalesce(text, ''), '@LONG', '[X]'), 'İIıŞşĞğÇçÖöÜü', 'iiissggccoouu')), r'[\t-\r \x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+', ' ')) AS plain FROM {documents}) q".replace("@LONG", "[A-Za-z0-9_-]" * 20 + "+"),
        r"SELECT doc_id, md5(plain) AS digest, length(plain) AS n_chars FROM (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(translate(regexp_replace(coalesce(text, ''), '[A-Za-z0-9_-]{20,}', '[X]', 'g'), 'İIıŞşĞğÇçÖöÜü', 'iiissggccoouu')), '[\t-\r \x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+'), lambda w: w <> ''), ' ') AS plain FROM {documents})"),
}
STATEMENTS = {n: Statement(text, S, {") IGNORE NULLS": " IGNORE NULLS)"}, check) for n, (text, check) in PAIRS.items()}
