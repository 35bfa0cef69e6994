"""Trades from signals, and the decisions that let signals through.

Both carry state from row to row: a position whose exit depends on its own entry, and counters of what a day has accepted
so far. Rows are sorted by key and order and streamed in Arrow batches, so a task holds one batch and the state of one key.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.sources.bars import BARS_SQL, bars
from barloom.sources.tables import INSTRUMENTS

FILLS = ("NEXT_OPEN", "NEXT_CLOSE", "SAME_CLOSE")
TRADE = "symbol long, entry_time date, exit_time date, quantity double, entry_price double, exit_price double, entry_cost double, exit_cost double, gross_pnl double, net_pnl double, return_pct double, bars_held int, exit_reason string"


@dataclass(frozen=True)
class Rules:
    """fill: the price of an order, of the next bar or of the signal's own. position_pct: share of the equity for a position.
    stop, target: losses and gains by the close, as shares of the entry price; most_bars: the longest time; each may be None."""

    fill: str = "NEXT_OPEN"
    capital: float = 100_000.0
    position_pct: float = 0.2
    least_notional: float = 1000.0
    cost_bps: float = 25.0
    whole_shares: bool = True
    warm_up: int = 5
    close_on_opposite: bool = True
    close_on_flat: bool = True
    stop: float | None = None
    target: float | None = None
    most_bars: int | None = None
    close_at_end: bool = True


class Account:
    """One symbol's cash and position. An order waits for the next bar unless it fills at the signal's own close."""

    def __init__(self, symbol, rules: Rules):
        self.symbol, self.rules, self.cash, self.held, self.waiting, self.k, self.last = symbol, rules, rules.capital, None, None, 0, None

    def enter(self, notional: float, price: float, ts) -> None:
        if price is None or price <= 0:
            return
        quantity = notional / price
        if self.rules.whole_shares:
            quantity = float(int(quantity))
        cost = quantity * price * self.rules.cost_bps / 10_000
        if quantity > 0 and quantity * price + cost <= self.cash:
            self.cash -= quantity * price + cost
            self.held = (ts, self.k, quantity, price, cost)

    def leave(self, reason: str, price: float, ts) -> tuple:
        since, k, quantity, paid, cost = self.held
        out = quantity * price * self.rules.cost_bps / 10_000
        gross = (price - paid) * quantity
        self.cash += quantity * price - out
        self.held = None
        return (self.symbol, since, ts, quantity, paid, price, cost, out, gross, gross - cost - out, (gross - cost - out) / (quantity * paid) * 100, self.k - k, reason)

    def _wish(self, close: float, signal: str | None) -> str | None:
        """Why the position should be closed now."""
        rules, (_, k, _, paid, _) = self.rules, self.held
        if rules.close_on_opposite and signal == "SHORT":
            return "OPPOSITE"
        if rules.close_on_flat and signal == "FLAT":
            return "FLAT"
        if rules.stop is not None and close <= paid * (1 - rules.stop):
            return "STOP"
        if rules.target is not None and close >= paid * (1 + rules.target):
            return "TARGET"
        return "TIME" if rules.most_bars is not None and self.k - k >= rules.most_bars else None

    def bar(self, ts, open_: float | None, close: float | None, signal: str | None):
        """The trades that end in this bar. A bar without a price fills nothing and is not judged."""
        self.k += 1
        rules, done = self.rules, []
        price = open_ if rules.fill == "NEXT_OPEN" else close
        if self.waiting and price is not None:
            what, value = self.waiting
            self.waiting = None
            if what == "leave":
                done.append(self.leave(value, price, ts))
            else:
                self.enter(value, price, ts)
        if close is None:
            return done
        self.last = (ts, close)
        if self.k < rules.warm_up or self.waiting:
            return done
        order = None
        if self.held:
            reason = self._wish(close, signal)
            order = reason and ("leave", reason)
        elif signal == "LONG" and self.cash * rules.position_pct >= rules.least_notional:
            order = ("enter", self.cash * rules.position_pct)
        if order and rules.fill == "SAME_CLOSE":
            what, value = order
            if what == "leave":
                done.append(self.leave(value, close, ts))
            else:
                self.enter(value, close, ts)
        else:
            self.waiting = order
        return done

    def end(self) -> list[tuple]:
        return [self.leave("END", self.last[1], self.last[0])] if self.held and self.rules.close_at_end else []


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True)], [n for n, _ in columns])


_TRADE = [("symbol", pa.int64()), ("entry_time", pa.date32()), ("exit_time", pa.date32())] + [(n, pa.float64()) for n in ("quantity", "entry_price", "exit_price", "entry_cost", "exit_cost", "gross_pnl", "net_pnl", "return_pct")] + [("bars_held", pa.int32()), ("exit_reason", pa.string())]


def trades_from_signals(rows: DataFrame, rules: Rules) -> DataFrame:
    """rows(symbol, ts, open, close, signal) -> the closed trades of each symbol, one position at a time, long only. signal
    is LONG, FLAT, SHORT or anything else, which changes nothing. A position that is open at the end is closed at the last
    close, unless the rules leave it open. Bars of one stamp come by open and close; an empty table gives no trades."""
    if rules.fill not in FILLS:
        raise ValueError(f"fill is one of {', '.join(FILLS)}")

    def run(batches):
        account = None
        for batch in batches:
            done = []
            for symbol, ts, open_, close, signal in zip(*(batch.column(c).to_pylist() for c in ("symbol", "ts", "open", "close", "signal")), strict=True):
                if account is None or symbol != account.symbol:
                    done += account.end() if account else []
                    account = Account(symbol, rules)
                done += account.bar(ts, open_, close, signal)
            yield _batch(done, _TRADE)
        if account:
            yield _batch(account.end(), _TRADE)

    slim = rows.select(F.col("symbol").cast("long").alias("symbol"), F.col("ts").cast("date").alias("ts"), F.col("open").cast("double").alias("open"), F.col("close").cast("double").alias("close"), "signal")
    return slim.repartition("symbol").sortWithinPartitions("symbol", "ts", "open", "close").mapInArrow(run, TRADE)


def _mean(column: str, n: int, by: str = "symbol") -> Column:
    w = Window.partitionBy(by).orderBy("ts").rowsBetween(1 - n, 0)
    return F.when(F.count(column).over(w) == n, F.avg(column).over(w))


def trend_signals(rows: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """Adds signal: LONG above both rising averages, SHORT below both falling ones, FLAT where the close crosses the fast
    one only, HOLD before the averages are full."""
    f, s, close = F.col("fast"), F.col("slow"), F.col("close")
    signal = F.when(f.isNull() | s.isNull(), "HOLD").when((close > f) & (f > s), "LONG").when((close < f) & (f < s), "SHORT").when(close < f, "FLAT").otherwise("HOLD")
    return rows.withColumns({"fast": _mean("close", fast), "slow": _mean("close", slow)}).withColumn("signal", signal)


NEXT_OPEN, NEXT_CLOSE, SAME_CLOSE = Rules(), Rules("NEXT_CLOSE", stop=0.15, target=0.3, most_bars=10), Rules("SAME_CLOSE", stop=0.1, whole_shares=False, close_on_flat=False, close_at_end=False)
_MONEY = ("entry_cost", "exit_cost", "gross_pnl", "net_pnl", "return_pct", "quantity")


def _rounded(trades: DataFrame) -> DataFrame:
    return trades.withColumns({c: F.round(c, 4) for c in _MONEY})


def g07_trades_next_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trades_from_signals(trend_signals(bars(spark, sf_dir)), NEXT_OPEN))


def g07_trades_next_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a stop, a target and a longest time, which depend on the entry."""
    return _rounded(trades_from_signals(trend_signals(bars(spark, sf_dir)), NEXT_CLOSE))


def g07_trades_same_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trades_from_signals(trend_signals(bars(spark, sf_dir)), SAME_CLOSE))


def _trades_sql(rules: Rules) -> str:
    """The same machine as a recursion over the bars of all symbols at once: each step takes one bar."""
    price = "open" if rules.fill == "NEXT_OPEN" else "close"
    same = rules.fill == "SAME_CLOSE"
    rate = rules.cost_bps / 10_000
    wishes = [
        ("signal = 'SHORT'", "OPPOSITE") if rules.close_on_opposite else None, ("signal = 'FLAT'", "FLAT") if rules.close_on_flat else None,
        (f"close <= paid * {1 - rules.stop!r}", "STOP") if rules.stop is not None else None, (f"close >= paid * {1 + rules.target!r}", "TARGET") if rules.target is not None else None,
        (f"k - entry_k >= {rules.most_bars}", "TIME") if rules.most_bars is not None else None,
    ]
    wish = f"CASE {' '.join(f'WHEN {c} THEN {r!r}' for c, r in filter(None, wishes))} END"
    shares = lambda notional, at: f"trunc({notional} / {at})" if rules.whole_shares else f"({notional} / {at})"
    state = "cash, q, paid, cost, entry_k, since"
    kept = "CASE WHEN {0} THEN {1} ELSE {2} END"

    def enter(source: str, at: str, wants: str, notional: str) -> str:
        """A statement that opens a position where `wants` holds and there is cash for it."""
        n = shares(notional, at)
        can = f"({wants} AND {n} > 0 AND {n} * {at} + {n} * {at} * {rate!r} <= cash)"
        new = {"cash": f"cash - ({n} * {at} + {n} * {at} * {rate!r})", "q": n, "paid": at, "cost": f"{n} * {at} * {rate!r}", "entry_k": "k", "since": "ts"}
        rest = ", ".join(f"{kept.format(can, new[c], c)} AS {c}" for c in new)
        return f"SELECT * EXCLUDE ({state}), {rest} FROM ({source})"

    def leave(source: str, at: str, wants: str, reason: str) -> str:
        new = {"cash": f"cash + (q * {at} - q * {at} * {rate!r})", "q": "0.0", "paid": "NULL", "cost": "NULL", "entry_k": "NULL", "since": "NULL"}
        out = f"CASE WHEN {wants} THEN {{'since': since, 'q': q, 'paid': paid, 'at': {at}, 'cost': cost, 'bars': k - entry_k, 'reason': {reason}}} ELSE done END AS done"
        return f"SELECT * EXCLUDE ({state}, done), {out}, {', '.join(f'{kept.format(wants, new[c], c)} AS {c}' for c in new)} FROM ({source})"

    done = "NULL::STRUCT(since DATE, q DOUBLE, paid DOUBLE, \"at\" DOUBLE, cost DOUBLE, bars BIGINT, reason VARCHAR)"
    step = f"SELECT b.symbol, b.ts, b.open, b.close, b.signal, b.k, r.waits, r.reason, r.notional, r.cash, r.q, r.paid, r.cost, r.entry_k, r.since, {done} AS done FROM r JOIN b ON b.symbol = r.symbol AND b.k = r.k + 1"
    step = leave(step, price, "coalesce(waits = 'leave', FALSE)", "reason")
    step = enter(step, price, "coalesce(waits = 'enter', FALSE)", "notional")
    order = f"SELECT * EXCLUDE (waits, reason, notional), CASE WHEN k < {rules.warm_up} THEN NULL WHEN q > 0 AND {wish} IS NOT NULL THEN 'leave' WHEN q = 0 AND signal = 'LONG' AND cash * {rules.position_pct} >= {rules.least_notional} THEN 'enter' END AS waits, {wish} AS reason, cash * {rules.position_pct} AS notional FROM ({step})"
    if same:
        order = leave(order, "close", "coalesce(waits = 'leave', FALSE)", "reason")
        order = f"SELECT * REPLACE (CASE WHEN waits = 'enter' THEN waits END AS waits) FROM ({order})"
        order = f"SELECT * REPLACE (NULL::VARCHAR AS waits) FROM ({enter(order, 'close', 'coalesce(waits = ' + repr('enter') + ', FALSE)', 'notional')})"
    names = "symbol, ts, open, close, signal, k, waits, reason, notional, cash, q, paid, cost, entry_k, since, done"
    start = f"SELECT symbol, ts, open, close, signal, 0 AS k, NULL::VARCHAR AS waits, NULL::VARCHAR AS reason, NULL::DOUBLE AS notional, {rules.capital!r}::DOUBLE AS cash, 0.0::DOUBLE AS q, NULL::DOUBLE AS paid, NULL::DOUBLE AS cost, NULL::BIGINT AS entry_k, NULL::DATE AS since, {done} AS done FROM b WHERE k = 1"
    ended = "UNION ALL SELECT symbol, ts, since, q, paid, close, cost, k - entry_k, 'END' FROM (SELECT *, max(k) OVER (PARTITION BY symbol) AS top FROM r) z WHERE k = top AND q > 0" if rules.close_at_end else ""
    gross = '("at" - paid) * q'
    out = f'q * "at" * {rate!r}'
    return f"""WITH RECURSIVE p AS ({BARS_SQL}),
m AS (SELECT *, row_number() OVER w AS k, CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS f, CASE WHEN row_number() OVER w >= 50 THEN avg(close) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS s FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
b AS MATERIALIZED (SELECT symbol, ts, open, close, k, CASE WHEN f IS NULL OR s IS NULL THEN 'HOLD' WHEN close > f AND f > s THEN 'LONG' WHEN close < f AND f < s THEN 'SHORT' WHEN close < f THEN 'FLAT' ELSE 'HOLD' END AS signal FROM m),
r AS ({start} UNION ALL SELECT {names} FROM ({order})),
t AS (SELECT symbol, ts, done.since AS since, done.q AS q, done.paid AS paid, done."at" AS "at", done.cost AS cost, done.bars AS bars, done.reason AS reason FROM r WHERE done IS NOT NULL {ended})
SELECT symbol, since AS entry_time, ts AS exit_time, round(q, 4) AS quantity, paid AS entry_price, "at" AS exit_price, round(cost, 4) AS entry_cost, round({out}, 4) AS exit_cost, round({gross}, 4) AS gross_pnl, round({gross} - cost - {out}, 4) AS net_pnl, round(({gross} - cost - {out}) / (q * paid) * 100, 4) AS return_pct, bars AS bars_held, reason AS exit_reason FROM t"""


@dataclass(frozen=True)
class Limits:
    """What one signal must meet (P21), and what the signals of a day may take together (G09)."""

    score: float = 60.0
    confidence: float = 0.5
    reward: float = 1.2
    position_pct: float = 0.2
    turnover: float = 10_000.0
    atr_pct: float = 0.6
    cost_bps: float = 50.0
    short: bool = False
    ml_score: float = 40.0
    daily: int = 5
    per_sector: int = 2
    risk_pct: float = 0.06


LIMITS = Limits()


def risk_reasons(signals: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Adds reasons, the rules that a signal breaks, in order: score, confidence, reward, stop, size (of the position and at
    least one share), liquidity, volatility, cost, side, model score. A null that a rule reads breaks none but reward and
    stop, which want a value; no model score is no reason."""
    broken = {
        "SCORE": F.col("score") < limits.score, "CONFIDENCE": F.col("confidence") < limits.confidence, "REWARD": F.coalesce(F.col("reward") < limits.reward, F.lit(True)), "STOP": F.coalesce(F.col("stop") <= 0, F.lit(True)),
        "POSITION": F.col("position_pct") > limits.position_pct + 0.0001, "TOO_SMALL": F.col("quantity") <= 0, "LIQUIDITY": F.col("turnover") < limits.turnover, "VOLATILITY": F.col("atr_pct") > limits.atr_pct,
        "COST": F.col("cost_bps") > limits.cost_bps, "SIDE": (F.col("direction") == "SHORT") & (not limits.short), "MODEL": F.col("ml_score") < limits.ml_score,
    }
    return signals.withColumn("reasons", F.array_compact(F.array(*(F.when(c, k) for k, c in broken.items()))))


def admitted(signals: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """signals(day, symbol, sector, score, risk_pct, reasons) -> all of them with place and decision. The signals of a day
    that break no rule are taken by score (ties: by symbol) as long as the day has room: at most `daily` in all,
    `per_sector` of a sector, one of a symbol, and risk_pct of risk together. What is refused leaves the counters as they
    were, so each decision depends on all before it. A null risk counts as none, a null sector as one of its own."""
    out = [("day", pa.date32()), ("symbol", pa.int64()), ("sector", pa.string()), ("score", pa.float64()), ("risk_pct", pa.float64()), ("place", pa.int64()), ("decision", pa.string())]

    def run(batches):
        day, place, count, risk, sectors, symbols = object(), 0, 0, 0.0, Counter(), set()
        for batch in batches:
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("day", "symbol", "sector", "score", "risk_pct", "reason")), strict=True):
                if row[0] != day:
                    day, place, count, risk, sectors, symbols = row[0], 0, 0, 0.0, Counter(), set()
                place += 1
                _, symbol, sector, _, takes, reason = row
                takes = takes or 0.0
                decision = reason or (
                    "DAILY_LIMIT" if count >= limits.daily else "SECTOR_LIMIT" if sectors[sector] >= limits.per_sector
                    else "RISK_LIMIT" if risk + takes > limits.risk_pct + 0.0001 else "HELD" if symbol in symbols else "ACCEPT"
                )
                if decision == "ACCEPT":
                    count, risk = count + 1, risk + takes
                    sectors[sector] += 1
                    symbols.add(symbol)
                done.append((*row[:5], place, decision))
            yield _batch(done, out)

    slim = signals.select(F.col("day").cast("date").alias("day"), F.col("symbol").cast("long").alias("symbol"), F.col("sector").cast("string").alias("sector"), F.col("score").cast("double").alias("score"), F.col("risk_pct").cast("double").alias("risk_pct"), F.get("reasons", F.lit(0)).alias("reason"))
    ordered = slim.repartition("day").sortWithinPartitions("day", F.desc_nulls_last("score"), "symbol")
    return ordered.mapInArrow(run, "day date, symbol long, sector string, score double, risk_pct double, place long, decision string")


def scored_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal for each symbol and day that trends, with what the rules read."""
    rows = trend_signals(bars(spark, sf_dir)).withColumns({"spread": F.col("high") - F.col("low"), "value": F.col("close") * F.col("volume")})
    rows = rows.withColumns({"atr": _mean("spread", 14), "turnover": _mean("value", 20)}).where("signal in ('LONG', 'SHORT') and atr is not null")
    close, atr = F.col("close"), F.col("atr")
    rows = rows.join(INSTRUMENTS.frame(spark, sf_dir).select("symbol", "sector"), "symbol")
    stop = close - 2 * atr
    quantity = F.floor(F.lit(20_000.0) / close)
    return rows.select(
        F.col("ts").alias("day"), "symbol", "sector", F.col("signal").alias("direction"), F.floor(F.abs(close / F.col("slow") - 1) * 100 + 50).cast("double").alias("score"),
        F.round(F.col("volume") / 50, 4).cast("double").alias("confidence"), stop.alias("stop"), F.try_divide(F.col("high") - close, close - F.col("low")).alias("reward"), quantity.cast("double").alias("quantity"),
        F.round(quantity * close / 100_000, 6).alias("position_pct"), F.col("turnover"), F.round(atr / close, 6).alias("atr_pct"), (F.lit(25.0) + F.pmod("symbol", F.lit(40))).alias("cost_bps"),
        F.when(F.pmod("symbol", F.lit(3)) > 0, F.pmod(F.col("symbol") * 7, F.lit(100)).cast("double")).alias("ml_score"), F.round(F.least(F.lit(0.05), 2 * atr * 0.02 / close), 4).alias("risk_pct"),
    )


def p21_risk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk_reasons(scored_signals(spark, sf_dir))
    return found.select("day", "symbol", F.concat_ws(",", "reasons").alias("reasons"))


#: The reward is seldom high enough in these bars to leave a day many signals, so the pass over a day asks for less.
WIDE = Limits(score=0.0, confidence=0.0, reward=0.0, position_pct=1.0, turnover=0.0, atr_pct=10.0, cost_bps=60.0, short=True, ml_score=10.0, daily=3, per_sector=1, risk_pct=0.07)


def g09_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(risk_reasons(scored_signals(spark, sf_dir), WIDE), WIDE)


_SIGNALS_SQL = f"""p AS ({BARS_SQL}),
m AS (SELECT *, row_number() OVER w AS k, avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS f, avg(close) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS s, avg(high - low) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr, avg(close * volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS turnover FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
g AS (
  SELECT ts AS day, m.symbol, r_name AS sector, CASE WHEN close > f AND f > s THEN 'LONG' WHEN close < f AND f < s THEN 'SHORT' END AS direction, floor(abs(close / s - 1) * 100 + 50) AS score, round(volume / 50, 4) AS confidence, close - 2 * atr AS stop, (high - close) / nullif(close - low, 0) AS reward,
    floor(20000 / close) AS quantity, round(floor(20000 / close) * close / 100000, 6) AS position_pct, turnover, round(atr / close, 6) AS atr_pct, 25 + m.symbol % 40 AS cost_bps, CASE WHEN m.symbol % 3 > 0 THEN m.symbol * 7 % 100 END AS ml_score, round(least(0.05, 2 * atr * 0.02 / close), 4) AS risk_pct
  FROM m JOIN supplier ON s_suppkey = m.symbol JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE k >= 50),
signals AS (SELECT * FROM g WHERE direction IS NOT NULL)"""


def _reasons_sql(x: Limits) -> str:
    rules = {
        "SCORE": f"score < {x.score}", "CONFIDENCE": f"confidence < {x.confidence}", "REWARD": f"reward IS NULL OR reward < {x.reward}", "STOP": "stop <= 0", "POSITION": f"position_pct > {x.position_pct} + 0.0001", "TOO_SMALL": "quantity <= 0",
        "LIQUIDITY": f"turnover < {x.turnover}", "VOLATILITY": f"atr_pct > {x.atr_pct}", "COST": f"cost_bps > {x.cost_bps}", "SIDE": "FALSE" if x.short else "direction = 'SHORT'", "MODEL": f"ml_score < {x.ml_score}",
    }
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules.items()) + "], lambda x: x IS NOT NULL)"


QUERIES = {f.__name__: f for f in (g07_trades_next_open, g07_trades_next_close, g07_trades_same_close, p21_risk_reasons, g09_admission)}
ORACLES = {
    "g07_trades_next_open": _trades_sql(NEXT_OPEN), "g07_trades_next_close": _trades_sql(NEXT_CLOSE), "g07_trades_same_close": _trades_sql(SAME_CLOSE),
    "p21_risk_reasons": f"WITH {_SIGNALS_SQL} SELECT day, symbol, array_to_string({_reasons_sql(LIMITS)}, ',') AS reasons FROM signals",
    "g09_admission": f"""WITH RECURSIVE {_SIGNALS_SQL},
d AS MATERIALIZED (SELECT day, symbol, sector, score, risk_pct, row_number() OVER (PARTITION BY day ORDER BY score DESC, symbol) AS place, {_reasons_sql(WIDE)}[1] AS reason FROM signals),
r AS (
  SELECT day, NULL::BIGINT AS symbol, NULL::VARCHAR AS sector, NULL::DOUBLE AS score, NULL::DOUBLE AS risk_pct, 0::BIGINT AS place, NULL::VARCHAR AS decision, []::VARCHAR[] AS taken, 0.0::DOUBLE AS risk FROM d WHERE place = 1 UNION ALL
  SELECT day, symbol, sector, score, risk_pct, place, decision, CASE WHEN decision = 'ACCEPT' THEN list_append(taken, sector) ELSE taken END, CASE WHEN decision = 'ACCEPT' THEN risk + risk_pct ELSE risk END FROM (
    SELECT d.*, r.taken, r.risk, CASE WHEN d.reason IS NOT NULL THEN d.reason WHEN len(r.taken) >= {WIDE.daily} THEN 'DAILY_LIMIT' WHEN len(list_filter(r.taken, lambda x: x = d.sector)) >= {WIDE.per_sector} THEN 'SECTOR_LIMIT' WHEN r.risk + d.risk_pct > {WIDE.risk_pct} + 0.0001 THEN 'RISK_LIMIT' ELSE 'ACCEPT' END AS decision
    FROM r JOIN d ON d.day = r.day AND d.place = r.place + 1) q)
SELECT day, symbol, sector, score, risk_pct, place, decision FROM r WHERE place > 0""",
}
