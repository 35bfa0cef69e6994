"""Recursive smoothing: state carried over the bars of each symbol in one sorted pass.

The rows of a partition are sorted by symbol and time and streamed in Arrow batches, so a task holds one batch and the
state of one symbol, however long its series is.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def ewm_step(alpha: float, least: int) -> Callable[[float | None], float | None]:
    """Exponential smoothing y = a x + (1 - a) y from the first value on; over a gap the old weight decays, and the last
    value is repeated. Null before `least` values."""
    state: list = [None, 1.0, 0]

    def step(x: float | None) -> float | None:
        if x is not None:
            state[2] += 1
            if state[0] is None:
                state[0] = x
            else:
                old = state[1] * (1 - alpha)
                state[0] = (old * state[0] + alpha * x) / (old + alpha)
            state[1] = 1.0
        elif state[0] is not None:
            state[1] *= 1 - alpha
        return state[0] if state[2] >= max(1, least) else None

    return step


def supertrend_step(multiplier: float) -> Callable:
    """(high, low, close, atr) -> (line, direction): bands that only tighten until the close crosses the active one."""
    state: list = []

    def step(high, low, close, atr):
        if None in (high, low, close, atr):
            return None, None
        middle, wide = (high + low) / 2, multiplier * atr
        up, down = middle + wide, middle - wide
        if not state:
            state.extend([up, down, close, False])
            return down, 1.0
        last_up, last_down, last_close, on_top = state
        up = up if up < last_up or last_close > last_up else last_up
        down = down if down > last_down or last_close < last_down else last_down
        on_top = close <= up if on_top else close < down
        state[:] = [up, down, close, on_top]
        return (up, -1.0) if on_top else (down, 1.0)

    return step


def scan(df: DataFrame, inputs: list[str], outputs: list[str], new_step: Callable[[], Callable[[tuple], tuple]], sorted_already: bool = False) -> DataFrame:
    """Adds double columns `outputs`: new_step() makes the state of a symbol, which maps the inputs of a row."""

    def run(batches):
        symbol, step = object(), None
        for batch in batches:
            found = []
            for key, values in zip(batch.column("symbol").to_pylist(), zip(*(batch.column(c).to_pylist() for c in inputs), strict=True), strict=True):
                if step is None or key != symbol:
                    symbol, step = key, new_step()
                found.append(step(values))
            columns = list(zip(*found, strict=True)) or [()] * len(outputs)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in columns)], [*batch.schema.names, *outputs])

    # A window orders rows within their symbol and shuffles only those that do not lie by symbol yet.
    ordered = df if sorted_already else df.withColumn("_place", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    kinds = T.StructType([*ordered.schema.fields, *(T.StructField(c, T.DoubleType()) for c in outputs)])
    return ordered.mapInArrow(run, kinds).drop("_place")


def ewm(df: DataFrame, specs: dict[str, tuple[str, float, int]], sorted_already: bool = False) -> DataFrame:
    """specs: {output: (input, alpha, least values)}; all columns of a request in one pass."""
    inputs = sorted({c for c, _, _ in specs.values()})

    def new_step():
        steps = [(inputs.index(c), ewm_step(alpha, least)) for c, alpha, least in specs.values()]
        return lambda values: tuple(step(values[i]) for i, step in steps)

    return scan(df, inputs, list(specs), new_step, sorted_already)


def ewm_sql(at: str, name: str, specs: dict[str, tuple[str, float, int]]) -> list[str]:
    """The same as common table expressions over `at`; the last one is called `name`."""
    cells = list(enumerate(specs.items()))
    start = ", ".join(f"CAST({c} AS DOUBLE) AS y{i}, CAST(1 AS DOUBLE) AS w{i}" for i, (_, (c, _, _)) in cells)
    move = ", ".join(
        f"CASE WHEN r.y{i} IS NULL THEN t.{c} WHEN t.{c} IS NULL THEN r.y{i} ELSE (r.w{i} * {1 - a!r} * r.y{i} + {a!r} * t.{c}) / (r.w{i} * {1 - a!r} + {a!r}) END, CASE WHEN t.{c} IS NULL AND r.y{i} IS NOT NULL THEN r.w{i} * {1 - a!r} ELSE 1 END"
        for i, (_, (c, a, _)) in cells
    )
    final = ", ".join(f"CASE WHEN count(t.{c}) OVER (PARTITION BY t.symbol ORDER BY t.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= {max(1, least)} THEN r.y{i} END AS {out}" for i, (out, (c, _, least)) in cells)
    return [
        f"{name}_n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS {name}_k FROM {at})",
        f"{name}_r AS (SELECT symbol, {name}_k AS k, {start} FROM {name}_n WHERE {name}_k = 1 UNION ALL SELECT t.symbol, t.{name}_k, {move} FROM {name}_r r JOIN {name}_n t ON t.symbol = r.symbol AND t.{name}_k = r.k + 1)",
        f"{name} AS (SELECT t.*, {final} FROM {name}_n t JOIN {name}_r r ON r.symbol = t.symbol AND r.k = t.{name}_k)",
    ]
