"""Research tables derived from the given ones: instruments, votes, outcomes, trades, statements."""

from __future__ import annotations

from barloom.plans.layers import Source
from barloom.plans.statements import Statement, table
from barloom.sources.bars import BARS


def derived(text: str, **sources: Source) -> Source:
    made = Statement(text, sources)
    return Source(made.frame, made.sql())


INSTRUMENTS = derived(
    "SELECT s.s_suppkey AS symbol, s.s_name AS name, r.r_name AS sector, n.n_name AS country, s.s_acctbal AS size, CASE WHEN s.s_acctbal < 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey",
    supplier=table("supplier"), nation=table("nation"), region=table("region"),
)

_W = "OVER (PARTITION BY b.symbol ORDER BY b.ts"
#: One row for each symbol and day with what breadth needs; null where a window is not full.
BREADTH = derived(
    "SELECT b.symbol, b.ts, b.open, b.high, b.low, b.close, b.volume, i.sector, lag(b.close) " + _W + ") AS previous_close, "
    + ", ".join(f"CASE WHEN count(b.close) {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(b.close) {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS ma_{n}" for n in (20, 50, 100, 200))
    + ", " + ", ".join(f"max(b.high) {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS high_{n}d, min(b.low) {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS low_{n}d" for n in (20, 252))
    + ", " + ", ".join(f"lag(b.close, {n}) {_W}) AS close_{n}_ago" for n in (20, 50, 100))
    + " FROM {bars} b JOIN {instruments} i ON b.symbol = i.symbol",
    bars=BARS, instruments=INSTRUMENTS,
)
RETURNS = derived("SELECT symbol, sector, ts, close, volume, close / nullif(previous_close, 0) - 1 AS r FROM {breadth} WHERE previous_close IS NOT NULL", breadth=BREADTH)
INDEX = derived("SELECT ts, avg(r) AS market FROM {returns} GROUP BY ts", returns=RETURNS)

#: A line item as a closed trade.
TRADES = table(
    "lineitem",
    "l_orderkey * 100 + l_linenumber AS trade_id, l_suppkey AS symbol, l_returnflag AS strategy, l_linestatus AS regime, CAST(l_shipdate AS DATE) AS ts, l_quantity AS quantity, CAST(floor(l_extendedprice * 100 / l_quantity) AS DOUBLE) AS price, l_extendedprice AS notional, round(l_discount - 0.045, 4) AS gross_return, round(l_tax / 100, 6) AS cost_rate, 1 + l_orderkey % 20 AS bars_held",
)
#: An order as a scored signal with its outcome.
OUTCOMES = derived(
    "SELECT o.o_orderkey AS signal_id, o.o_custkey AS symbol, o.o_orderpriority AS strategy, c.c_mktsegment AS cohort, CAST(o.o_orderdate AS DATE) AS ts, least(100, floor(o.o_totalprice / 40) / 100.0) AS score, floor(c.c_acctbal * 2) / 1000.0 AS net_return, CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS hit, o.o_orderstatus AS state FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey",
    orders=table("orders"), customer=table("customer"),
)
#: Quarterly statements of customers.
STATEMENTS = derived(
    "SELECT o_custkey AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, CAST(extract(year FROM o_orderdate) AS INT) AS fiscal_year, CAST(extract(quarter FROM o_orderdate) AS INT) AS fiscal_quarter, sum(o_totalprice) AS revenue, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 0.3 ELSE o_totalprice * 0.1 END) AS profit, sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice ELSE 0 END) AS debt, count(*) AS n_orders FROM {orders} GROUP BY 1, 2, 3, 4",
    orders=table("orders"),
)
POSITIONS = derived(
    "SELECT t.symbol, i.sector, t.strategy, t.cost, t.notional, t.notional / sum(t.notional) OVER () AS weight FROM (SELECT symbol, strategy, sum(notional) AS notional, sum(notional * cost_rate) AS cost FROM {trades} GROUP BY symbol, strategy) t JOIN {instruments} i ON t.symbol = i.symbol",
    trades=TRADES, instruments=INSTRUMENTS,
)
EVENTS = table("events", "event_id, user_id, ts, event_type, value")
