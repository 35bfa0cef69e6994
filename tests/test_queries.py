"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os
from concurrent.futures import Future, ThreadPoolExecutor
from itertools import islice

import duckdb
import pytest

from barloom.plans import registry

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Every query by default; QUERIES=7 takes each seventh, for a quick look.
EVERY = int(os.environ.get("QUERIES", "1"))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(v)
    return str(v)


NAMES = list(islice(sorted(registry.ORACLES), 0, None, EVERY))
UNCHECKED = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.fixture(scope="module")
def answers(spark):
    """Columns and rows of all queries: several are planned and run at once, as most of their time is the driver's."""

    def answer(name: str) -> tuple[list[str], list]:
        df = registry.QUERIES[name](spark, SMALL)
        return df.columns, df.take(1) if name in UNCHECKED else df.collect()

    pool = ThreadPoolExecutor(6)
    found: dict[str, Future] = {name: pool.submit(answer, name) for name in [*NAMES, *UNCHECKED]}
    yield found
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(answers, tables, name):
    columns, rows = answers[name].result()
    want = tables.sql(registry.ORACLES[name])
    assert sorted(columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    key = lambda r: (tuple((x is None, str(x)) for x in r if not isinstance(x, float) or x == int(x)), tuple(x for x in r if isinstance(x, float)))
    got = sorted((tuple(map(plain, r)) for r in rows), key=key)
    other = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=key)
    assert len(got) == len(other)
    wrong = [(a, b) for a, b in zip(got, other, strict=True) if any(x != y and not (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 + 1e-6 * abs(y)) for x, y in zip(a, b, strict=True))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", UNCHECKED)
def test_query_without_sql_returns_rows(answers, name):
    assert answers[name].result()[1]


def test_every_plan_reads_its_tables_by_columns(spark):
    plan = registry.QUERIES["wn01_sma"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "l_discount" not in schema and "l_extendedprice" in schema
