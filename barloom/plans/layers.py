"""Plans as layers of named expressions over a source.

A plan adds columns layer by layer, each layer seeing the ones before it. `frame` makes it a DataFrame: windows with the
same partition and order share one sort, and Catalyst prunes what the last projection does not need. `sql` renders the
same plan as one ANSI statement, against which the DataFrame is checked.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.recursive import ewm, ewm_sql


@dataclass(frozen=True)
class Source:
    frame: Callable[[SparkSession, str], DataFrame]
    sql: str


@dataclass(frozen=True)
class Plan:
    """layers: {column: expression}; {column: (input, alpha, least values)} for recursive smoothing; or a string, where
    'where ...' filters and 'group keys | aggregates' regroups."""

    source: Source
    layers: tuple = ()
    out: tuple[str, ...] = ()
    digits: dict[str, int] = field(default_factory=dict)

    def then(self, *layers) -> Plan:
        return replace(self, layers=(*self.layers, *layers))

    def returning(self, *out: str, **digits: int) -> Plan:
        return replace(self, out=out, digits=digits)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df, smoothed = self.source.frame(spark, sf_dir), False
        for k, layer in enumerate(self.layers):
            if isinstance(layer, str) and layer.startswith("where "):
                df = df.where(layer[6:])
            elif isinstance(layer, str):
                keys, aggregates = _grouping(layer)
                df = df.groupBy(*keys).agg(*(F.expr(spark_text(a)) for a in aggregates))
            elif _recursive(layer):
                # Smoothing reads every column of a row: those that nothing names from here on are left out.
                named = set(re.findall(r"\w+", f"{self.layers[k:]} {self.out}"))
                used = df.select(*(c for c in df.columns if not self.out or c in named | {"symbol", "ts"}))
                df, smoothed = ewm(used, layer, smoothed), True
            else:
                df = df.withColumns({c: F.expr(spark_text(e)) for c, e in layer.items()})
                smoothed = smoothed and not any(" OVER (" in e for e in layer.values())
        return df.selectExpr(*(f"{spark_text(self._rounded(c))} AS {_name(c)}" for c in self.out)) if self.out else df

    def sql(self) -> str:
        parts, at = [f"s0 AS ({self.source.sql})"], "s0"
        for k, layer in enumerate(self.layers, 1):
            if _recursive(layer):
                parts += ewm_sql(at, f"s{k}", layer)
                at = f"s{k}"
                continue
            if isinstance(layer, str) and layer.startswith("where "):
                body = f"SELECT * FROM {at} WHERE {duck_text(layer[6:])}"
            elif isinstance(layer, str):
                keys, aggregates = _grouping(layer)
                body = f"SELECT {', '.join(map(duck_text, [*keys, *aggregates]))} FROM {at}" + (f" GROUP BY {', '.join(keys)}" if keys else "")
            else:
                body = f"SELECT *, {', '.join(f'{duck_text(e)} AS {c}' for c, e in layer.items())} FROM {at}"
            at = f"s{k}"
            parts.append(f"{at} AS ({body})")
        out = ", ".join(f"{duck_text(self._rounded(c))} AS {_name(c)}" for c in self.out) if self.out else "*"
        return f"WITH RECURSIVE {', '.join(parts)} SELECT {out} FROM {at}"

    def _rounded(self, column: str) -> str:
        expression = column.rsplit(" AS ", 1)[0]
        return f"round(CAST({expression} AS DOUBLE), {self.digits[_name(column)]})" if _name(column) in self.digits else expression


def _recursive(layer) -> bool:
    return isinstance(layer, dict) and isinstance(next(iter(layer.values())), tuple)


def _name(column: str) -> str:
    return column.rsplit(" AS ", 1)[-1]


def _grouping(layer: str) -> tuple[list[str], list[str]]:
    """'group a, b | count(*) AS n; sum(x) AS s' -> keys and aggregates."""
    keys, aggregates = layer.removeprefix("group").split("|", 1)
    return [k.strip() for k in keys.split(",") if k.strip()], [a.strip() for a in aggregates.split(";") if a.strip()]


#: Functions that the two dialects name differently: (neutral, Spark, checking engine).
_NAMES = [
    ("exact_percentile(", "percentile(", "quantile_cont("),
    ("gather(", "collect_list(", "list("),
    ("length_of(", "size(", "len("),
    ("kept_in(", "filter(", "list_filter("),
    ("day_number(", "unix_date(", "date_diff('day', DATE '1970-01-01', "),
    ("hash_text(", "md5(", "md5("),
    ("matches_of(", "regexp_like(", "regexp_matches("),
    ("replace_all(", "regexp_replace(", "regexp_replace("),
]


def spark_text(text: str) -> str:
    """Numbers with a point are doubles, not decimals."""
    for neutral, own, _ in _NAMES:
        text = text.replace(neutral, own)
    return re.sub(r"(?<![\w.])(\d+\.\d+(?:e-?\d+)?)(?![\w.])", r"\1D", text)


def duck_text(text: str) -> str:
    for neutral, _, other in _NAMES:
        text = text.replace(neutral, other)
    return re.sub(r"\bv -> ", "lambda v: ", text)


# Windows of one symbol by time.
OVER = "OVER (PARTITION BY symbol ORDER BY ts"


def rows(n: int, end: int = 0) -> str:
    """The n rows that end `end` rows before this one."""
    return f"{OVER} ROWS BETWEEN {n - 1 + end} PRECEDING AND {f'{end} PRECEDING' if end else 'CURRENT ROW'})"


def lag(column: str, n: int = 1) -> str:
    return f"lag({column}, {n}) {OVER})"


def lead(column: str, n: int = 1) -> str:
    return f"lead({column}, {n}) {OVER})"


def running(aggregate: str) -> str:
    return f"{aggregate} {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def roll(aggregate: str, column: str, n: int, end: int = 0, full: bool = True) -> str:
    """An aggregate over a window; null until the window holds n values, unless full is off."""
    window = rows(n, end)
    value = f"{aggregate}({column}) {window}"
    return f"CASE WHEN count({column}) {window} = {n} THEN {value} END" if full else value


def over_zero(a: str, b: str) -> str:
    """a / b, null where b is zero."""
    return f"(({a}) / nullif({b}, 0))"


def clip(x: str, low: float, high: float) -> str:
    """Null stays null."""
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"


def flag(condition: str) -> str:
    """1.0 or 0.0; an unknown condition is 0.0."""
    return f"CASE WHEN {condition} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


def sign(a: str, b: str) -> str:
    """1, -1 or 0 by comparison of a with b; an unknown one is 0."""
    return f"CASE WHEN {a} > {b} THEN CAST(1 AS DOUBLE) WHEN {a} < {b} THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
