"""The streaming jobs as queries: the batch twins over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.bars import BARS_SQL, bars, read
from barloom.streaming import drift
from barloom.streaming.jobs import activity_sessions, alerts, event_bars
from barloom.streaming.machines import AlertPolicy, first_exits, signal_lives, watch_list


def x06_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(read(spark, sf_dir, "events"))


def x06_activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_sessions(read(spark, sf_dir, "events"))


def x01_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(read(spark, sf_dir, "events"))


def _newest(events: DataFrame) -> int | None:
    return events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]


def x03_signal_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lives of all signals up to the newest event."""
    events = read(spark, sf_dir, "events")
    return signal_lives(events, until=_newest(events))


#: More alerts for one signal, no digest, and no way around the cooldown.
STRICT = AlertPolicy(cooldown=6 * 3600 * 1_000_000, change=10.0, most=2, digest_below=2, repeat_critical=False)


def x01_alert_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with a limit of alerts and a digest for low priorities."""
    return signal_lives(read(spark, sf_dir, "events"), STRICT).where("decision is not null").select("user_id", "event_type", "at", "decision", "alerts")


def x05_watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return watch_list(events, until=_newest(events))


def x04_exit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exits with the bar at which they are known, a position for each bar."""
    rows = bars(spark, sf_dir).select("symbol", "ts", F.lit(0).alias("tie"), F.col("close").alias("value"))
    return first_exits(rows, 0.2, -0.15, 12)


QUERIES = {f.__name__: f for f in (x06_event_bars, x06_activity_sessions, x01_alerts, x03_signal_lives, x01_alert_decisions, x05_watch_list, x04_exit_events, drift.x08_drift_monitor)}


def _lives_sql(p: AlertPolicy) -> str:
    """A recursion over the rows of all signals, one of each at a time."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_type, epoch_us(ts) AS t, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE ts IS NOT NULL),
r AS (
  SELECT user_id, event_type, 0::BIGINT AS k, NULL::BIGINT AS t, FALSE AS alive, NULL::DOUBLE AS score, 0::BIGINT AS alerts, NULL::BIGINT AS told, NULL::BIGINT AS valid, FALSE AS lapsed, NULL::BIGINT AS lapsed_at, NULL::BIGINT AS lapsed_alerts, NULL::VARCHAR AS event, NULL::VARCHAR AS decision, NULL::BIGINT AS now_alerts FROM e WHERE k = 1 UNION ALL
  SELECT user_id, event_type, k, t, NOT ended, value, CASE WHEN sent THEN was + 1 ELSE was END, CASE WHEN sent THEN t ELSE told END, t + {p.validity}, lapsed, CASE WHEN lapsed THEN valid END, CASE WHEN lapsed THEN alerts END,
    CASE WHEN ended THEN CASE WHEN there THEN 'INVALIDATED' END WHEN there THEN 'UPDATED' ELSE 'CREATED' END, CASE WHEN NOT ended THEN decision END, CASE WHEN ended THEN was WHEN sent THEN was + 1 ELSE was END FROM (
    SELECT *, NOT ended AND decision IN ('SEND', 'SEND_DIGEST_ONLY') AS sent FROM (
      SELECT *, CASE WHEN waits AND NOT ({p.repeat_critical} AND value >= 90 AND changed) THEN 'MUTE_COOLDOWN' WHEN NOT changed THEN 'MUTE_UNCHANGED' WHEN was >= {p.most} THEN 'MUTE_DUPLICATE' WHEN value < {(40, 70, 90)[p.digest_below - 1]} THEN 'SEND_DIGEST_ONLY' ELSE 'SEND' END AS decision FROM (
        SELECT *, value < {p.invalid_below} AS ended, NOT there OR abs(value - score) >= {p.change} AS changed, there AND told IS NOT NULL AND t - told < {p.cooldown} AS waits, CASE WHEN there THEN alerts ELSE 0 END AS was FROM (
          SELECT e.user_id, e.event_type, e.k, e.t, e.value, r.score, r.alerts, CASE WHEN r.alive AND r.valid + {p.grace} >= e.t THEN r.told END AS told, r.valid, r.alive AND r.valid + {p.grace} < e.t AS lapsed, r.alive AND r.valid + {p.grace} >= e.t AS there
          FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.k = r.k + 1) q1) q2) q3) q4),
last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY k DESC) = 1)"""


_SHORT = "CASE WHEN decision LIKE 'SEND%' THEN 'ACTIVE' WHEN decision = 'MUTE_COOLDOWN' THEN 'COOLDOWN' WHEN decision IS NULL THEN 'INVALIDATED' ELSE 'MUTED' END"
ORACLES = {
    "x06_event_bars": "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2",
    "x06_activity_sessions": "SELECT user_id, min(ts) AS start, count(*) AS n, max(value) AS top FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) f) g GROUP BY user_id, run",
    "x01_alerts": "WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id) AS k FROM events WHERE value >= 50), r AS (SELECT user_id, k, ts, value, 'FIRST' AS reason, ts AS told_ts, value AS told_value FROM e WHERE k = 1 UNION ALL SELECT user_id, k, ts, value, reason, CASE WHEN reason IS NULL THEN told_ts ELSE ts END, CASE WHEN reason IS NULL THEN told_value ELSE value END FROM (SELECT e.*, told_ts, told_value, CASE WHEN e.ts >= told_ts + INTERVAL 12 HOUR THEN 'COOLDOWN_OVER' WHEN e.value - told_value >= 30 THEN 'CHANGE' END AS reason FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) s) SELECT user_id, ts::TIMESTAMP AS ts, value, reason FROM r WHERE reason IS NOT NULL",
    "x03_signal_lives": f"""{_lives_sql(AlertPolicy())} SELECT user_id, event_type, t AS "at", event, decision, {_SHORT} AS state, now_alerts AS alerts FROM r WHERE event IS NOT NULL
UNION ALL SELECT user_id, event_type, lapsed_at, 'EXPIRED', NULL, 'EXPIRED', lapsed_alerts FROM r WHERE lapsed
UNION ALL SELECT user_id, event_type, valid, 'EXPIRED', NULL, 'EXPIRED', alerts FROM last WHERE alive AND valid + {AlertPolicy().grace} < (SELECT max(epoch_us(ts)) FROM events)""",
    "x01_alert_decisions": f'{_lives_sql(STRICT)} SELECT user_id, event_type, t AS "at", decision, now_alerts AS alerts FROM r WHERE decision IS NOT NULL',
    "x05_watch_list": """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, epoch_us(ts) AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
a AS (SELECT user_id, min(k) AS k FROM e WHERE value >= 70 GROUP BY user_id UNION ALL SELECT n.user_id, n.k FROM a JOIN e c ON c.user_id = a.user_id AND c.k = a.k, LATERAL (SELECT x.user_id, min(x.k) AS k FROM e x WHERE x.user_id = a.user_id AND x.value >= 70 AND x.t > c.t + 259200000000 GROUP BY x.user_id) n)
SELECT s.user_id, s.t AS added, s.t + 259200000000 AS expires, count(*) AS "rows", max(x.value) AS best FROM a JOIN e s ON s.user_id = a.user_id AND s.k = a.k JOIN e x ON x.user_id = a.user_id AND x.k >= s.k AND x.t <= s.t + 259200000000 GROUP BY s.user_id, s.t HAVING s.t + 259200000000 < (SELECT max(t) FROM e)""",
    "x04_exit_events": f"""WITH b AS MATERIALIZED (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM ({BARS_SQL}) p),
h AS (SELECT a.symbol, a.k AS k0, b.ts, b.k - a.k AS held, CASE WHEN b.close / a.close - 1 >= 0.2 THEN 'TARGET' WHEN b.close / a.close - 1 <= -0.15 THEN 'STOP' WHEN b.k - a.k = 12 THEN 'TIME' END AS rule FROM b a JOIN b ON b.symbol = a.symbol AND b.k - a.k BETWEEN 1 AND 12)
SELECT symbol, epoch_us(arg_min(ts, held)) AS "at", k0, arg_min(rule, held) AS rule, min(held) AS bars_held FROM h WHERE rule IS NOT NULL GROUP BY symbol, k0""",
    "x08_drift_monitor": drift.ORACLE,
}
