"""Layers of a plan over the bars of whole symbols, by numpy in one sorted pass.

The text of the layers is the same that `layers.py` renders for both engines. A request of many windows is one pass here,
where each layer would be one more window operator over rows of all columns so far. `supported` says whether all layers
can be worked out: windows of a symbol by time with frames of rows, sums of doubles oldest first as a frame is summed there.
A division by zero is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS = 32_768  #: rows that a task works out at once, about
BARS_COLUMNS = ("open", "high", "low", "close", "volume")
_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?(?:[eE]-?\d+)?)|('[^']*')|([A-Za-z_]\w*)|(<=|>=|<>|[-+*/(),<>=]))")
_FRAMED, _PLACED = {"sum", "avg", "count", "min", "max", "gather"}, {"lag", "row_number"}
_PLAIN = {"greatest", "least", "nullif", "coalesce", "abs", "sign", "ln", "sqrt", "exp", "array_position"}
_COMPARED = {"=", "<>", "<", ">", "<=", ">="}


class Unsupported(ValueError):
    """A text that only the engines can work out."""


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise Unsupported(text[at:])
            number, string, word, mark = found.groups()
            self.tokens.append(("number", float(number)) if number else ("string", string[1:-1]) if string else ("word", word) if word else ("mark", mark))
            at = found.end()
        self.at = 0

    def next_is(self, *values: str) -> bool:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return kind in ("word", "mark") and (value.upper() if kind == "word" else value) in values

    def took(self, *values: str) -> str | None:
        if self.next_is(*values):
            self.at += 1
            return self.tokens[self.at - 1][1].upper()
        return None

    def need(self, *values: str) -> None:
        for value in values:
            if not self.took(value):
                raise Unsupported(f"{value} at {self.tokens[self.at:self.at + 3]}")

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise Unsupported(str(self.tokens[self.at :]))
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.took("OR"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.took("AND"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.took("NOT") else self.compared()

    def compared(self) -> tuple:
        tree = self.added()
        if self.took("IS"):
            no = self.took("NOT")
            self.need("NULL")
            return ("not", ("null", tree)) if no else ("null", tree)
        mark = self.took(*_COMPARED)
        return (mark, tree, self.added()) if mark else tree

    def added(self) -> tuple:
        tree = self.multiplied()
        while mark := self.took("+", "-"):
            tree = (mark, tree, self.multiplied())
        return tree

    def multiplied(self) -> tuple:
        tree = self.signed()
        while mark := self.took("*", "/"):
            tree = (mark, tree, self.signed())
        return tree

    def signed(self) -> tuple:
        return ("neg", self.signed()) if self.took("-") else self.primary()

    def primary(self) -> tuple:
        if self.took("("):
            tree = self.either()
            self.need(")")
            return tree
        if self.took("CASE"):
            cases = []
            while self.took("WHEN"):
                when = self.either()
                self.need("THEN")
                cases.append((when, self.either()))
            other = self.either() if self.took("ELSE") else ("literal", None)
            self.need("END")
            return ("case", tuple(cases), other)
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind in ("number", "string"):
            return ("literal", value)
        if kind != "word":
            raise Unsupported(f"{value!r}")
        if value.upper() == "NULL":
            return ("literal", None)
        if not self.took("("):
            return ("column", value)
        if value.upper() == "CAST":
            tree = self.either()
            self.need("AS", "DOUBLE", ")")
            return tree
        arguments = []
        while not self.took(")"):
            arguments.append(self.either())
            self.took(",")
        if self.took("OVER"):
            return self.window(value.lower(), tuple(arguments))
        if value.lower() not in _PLAIN:
            raise Unsupported(value)
        return (value.lower(), *arguments)

    def window(self, name: str, arguments: tuple) -> tuple:
        self.need("(", "PARTITION", "BY", "SYMBOL")
        run = self.added() if self.took(",") else None
        self.need("ORDER", "BY", "TS")
        frame = None
        if self.took("ROWS"):
            self.need("BETWEEN")
            frame = (self.bound(), self.need("AND") or self.bound())
        self.need(")")
        known = name in _PLACED if frame is None else name in _FRAMED
        if not known or (run is not None and name != "row_number") or (frame and frame[0] is None and name not in ("sum", "count")) or (frame and frame[1] is None):
            raise Unsupported(name)
        return ("window", name, arguments, run, frame)

    def bound(self) -> int | None:
        """Rows before this one; None is the first one."""
        if self.took("CURRENT"):
            self.need("ROW")
            return 0
        if self.took("UNBOUNDED"):
            self.need("PRECEDING")
            return None
        _, value = self.primary()
        self.need("PRECEDING")
        return int(value)


@lru_cache(4096)
def parsed(text: str) -> tuple:
    return _Parser(text).whole()


def supported(layers: tuple) -> bool:
    try:
        for layer in layers:
            for text in layer.values():
                parsed(text)
    except (Unsupported, AttributeError, TypeError):
        return False
    return True


class _Symbols:
    """Columns of the rows of whole symbols, as values and where they are not null."""

    def __init__(self, first: np.ndarray):
        """first: whether a row is the first one of its symbol."""
        self.n, self.columns, self.known = len(first), {}, {}
        self.starts = np.flatnonzero(first)
        self.place = self.since(first)

    def since(self, first: np.ndarray) -> np.ndarray:
        at = np.arange(self.n)
        return at - np.maximum.accumulate(np.where(first, at, 0))

    def value(self, tree: tuple) -> tuple[np.ndarray, np.ndarray]:
        if tree[0] == "column":
            return self.columns[tree[1]]
        if tree not in self.known:
            with np.errstate(all="ignore"):
                self.known[tree] = self.worked_out(tree)
        return self.known[tree]

    def worked_out(self, tree: tuple) -> tuple[np.ndarray, np.ndarray]:
        kind, *rest = tree
        if kind == "literal":
            kept = np.full(self.n, rest[0] is not None)
            return (np.full(self.n, rest[0], object) if isinstance(rest[0], str) else np.full(self.n, np.nan if rest[0] is None else rest[0])), kept
        if kind == "case":
            return self.chosen(*rest)
        if kind == "window":
            return self.windowed(*rest)
        if kind == "array_position":
            return self.position(*rest)
        parts = [self.value(t) for t in rest]
        (a, has), (b, other) = parts[0], parts[-1]
        both = has & other
        if kind == "null":
            return ~has, np.ones(self.n, bool)
        if kind == "not":
            return ~a, has
        if kind == "and":
            return a & b, both | (has & ~a) | (other & ~b)
        if kind == "or":
            return (a & has) | (b & other), both | (has & a) | (other & b)
        if kind in _COMPARED:
            return self.compared(kind, a, b), both
        if kind in "+-*/":
            if kind == "/":
                return a / b, both & (b != 0)
            return (a + b if kind == "+" else a - b if kind == "-" else a * b), both
        if kind == "neg":
            return -a, has
        if kind == "nullif":
            return a, has & ~(other & self.compared("=", a, b))
        if kind == "ln":
            return np.log(a), has & ~(a <= 0)
        if kind in ("abs", "sign", "sqrt", "exp"):
            return getattr(np, kind)(a), has
        # greatest, least and coalesce of any number of values; a null is left out, and NaN is above all numbers.
        for b, other in parts[1:]:
            if kind == "coalesce":
                a = np.where(has, a, b)
            else:
                a = np.where(has & other, np.maximum(a, b) if kind == "greatest" else np.fmin(a, b), np.where(has, a, b))
            has = has | other
        return a, has

    @staticmethod
    def compared(mark: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """NaN is equal to itself and above all numbers."""
        if a.dtype != object and b.dtype != object and (np.isnan(a).any() or np.isnan(b).any()):
            x, y = np.isnan(a), np.isnan(b)
            less, same = (a < b) | (y & ~x), (a == b) | (x & y)
        else:
            less, same = a < b, a == b
        return {"=": same, "<>": ~same, "<": less, ">": ~(less | same), "<=": less | same, ">=": ~less}[mark]

    def chosen(self, cases: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
        value, has = self.value(other)
        for when, then in reversed(cases):
            (met, known), (a, there) = self.value(when), self.value(then)
            met = met & known
            if a.dtype == object and value.dtype != object:
                value = value.astype(object)
            value, has = np.where(met, a, value), np.where(met, there, has)
        return value, has

    def shifted(self, values: np.ndarray, has: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Values k rows before in the symbol."""
        if k == 0:
            return values, has
        out, there = np.zeros_like(values), np.zeros(self.n, bool)
        out[k:] = values[: self.n - k]
        there[k:] = has[: self.n - k]
        return out, there & (self.place >= k)

    def counted(self, has: np.ndarray, start: int | None, end: int) -> np.ndarray:
        """Non-null values of a frame."""
        total = np.concatenate([[0], np.cumsum(has)])
        at = np.arange(self.n)
        first = at - self.place
        low = first if start is None else np.maximum(at - start, first)
        return np.where(at - end >= first, total[np.maximum(at - end + 1, 0)] - total[low], 0)

    def windowed(self, name: str, arguments: tuple, run: tuple | None, frame: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        always = np.ones(self.n, bool)
        if name == "row_number":
            place = self.place
            if run is not None:  # runs lie together: they are numbered in the order of time
                number = self.value(run)[0]
                first = self.place == 0
                first[1:] |= number[1:] != number[:-1]
                place = self.since(first)
            return place + 1.0, always
        values, has = self.value(arguments[0])
        if name == "lag":
            return self.shifted(values, has, int(arguments[1][1]) if len(arguments) > 1 else 1)
        count = self.counted(has, *frame)
        if name == "count":
            return count.astype(float), always
        if frame[0] is None:
            filled, out = np.where(has, values, 0.0), np.empty(self.n)
            for at, to in zip(self.starts, [*self.starts[1:], self.n], strict=True):
                out[at:to] = np.cumsum(filled[at:to])
            return self.shifted(out, always, frame[1])[0], count > 0
        if name == "gather":
            raise Unsupported("a list")
        nothing = {"sum": 0.0, "avg": 0.0, "max": -np.inf, "min": np.inf}[name]
        filled, total = np.where(has, values, nothing), np.full(self.n, nothing)
        for k in range(frame[0], frame[1] - 1, -1):  # oldest first
            part = filled if k == 0 else np.where(self.place[k:] >= k, filled[: self.n - k], nothing)
            to = total[k:]
            if name == "max":
                np.maximum(to, part, out=to)
            elif name == "min":
                np.fmin(to, part, out=to)
            else:
                to += part
        return (total / count if name == "avg" else total), count > 0

    def position(self, gathered: tuple, sought: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Place of a value in the list of a frame, oldest first; 0 where it is not there."""
        if gathered[0] == "column":
            gathered = self.trees[gathered[1]]
        _, name, arguments, _, (start, end) = gathered
        if name != "gather":
            raise Unsupported(name)
        (values, has), (value, known) = self.value(arguments[0]), self.value(sought)
        found, before = np.zeros(self.n), np.zeros(self.n)
        for k in range(start, end - 1, -1):
            own, there = self.shifted(values, has, k)
            before += there
            found = np.where((found == 0) & there & self.compared("=", own, value), before, found)
        return found, known

    def add(self, layer: dict[str, str]) -> None:
        made, self.trees = {}, getattr(self, "trees", {})
        for column, text in layer.items():
            tree = parsed(text)
            if tree[0] == "window" and tree[1] == "gather":
                self.trees[column] = tree
            else:
                made[column] = self.value(tree)
        self.columns |= made
        self.known = {}


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as the decimals that the doubles are written as, halves away from zero."""
    scale = 10.0**digits
    with np.errstate(all="ignore"):
        size = np.abs(values) * scale
        whole = np.floor(size)
        near = np.abs(size - whole - 0.5) <= 1e-15 * size + 1e-9
        out = np.copysign((whole + (size - whole >= 0.5)) / scale, values)
        large = size >= 2**52
    for i in np.flatnonzero((near | large) & np.isfinite(values)):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if size[i] < 1e25 else values[i]
    return np.where(np.isfinite(values), out + 0.0, values)


def over_symbols(bars: DataFrame, layers: tuple, out: tuple[str, ...], kinds: dict[str, str], digits: int | None = None, rows_at_once: int = ROWS) -> DataFrame:
    """bars(symbol, ts and those of BARS_COLUMNS that the layers name) -> `out` by their `kinds`: symbol and ts as they are and
    columns of the layers, doubles rounded to `digits`. A task holds `rows_at_once` and the rows of one symbol."""
    used = [c for c in BARS_COLUMNS if c in set(re.findall(r"\w+", f"{layers} {out}"))]

    def made(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        symbol = rows.column("symbol").combine_chunks().dictionary_encode("encode")
        code = (symbol.combine_chunks() if isinstance(symbol, pa.ChunkedArray) else symbol).indices.to_numpy(zero_copy_only=False)
        of = _Symbols(np.concatenate([[True], code[1:] != code[:-1]]))
        for c in used:
            column = rows.column(c)
            of.columns[c] = column.to_numpy(), column.is_valid().to_numpy()
        for layer in layers:
            of.add(layer)
        arrays = []
        for c in out:
            if c in ("symbol", "ts"):
                arrays.append(rows.column(c).combine_chunks())
                continue
            values, has = of.columns[c]
            if kinds[c] == "double" and digits is not None:
                values = half_up(values, digits)
            if kinds[c] == "string":
                arrays.append(pa.array(values, pa.string(), mask=~has))
            else:
                kind = {"double": (float, pa.float64()), "int": (np.int32, pa.int32()), "bigint": (np.int64, pa.int64())}[kinds[c]]
                arrays.append(pa.array(np.where(has, values, 0).astype(kind[0]), kind[1], mask=~has))
        return pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < rows_at_once:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            code = rows.column("symbol").combine_chunks().dictionary_encode("encode")
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(code != code[-1])[-1]) + 1 if code[0] != code[-1] else 0  # the last symbol may go on
            if last:
                yield made(rows.slice(0, last))
            held, n = rows.slice(last).to_batches(), rows.num_rows - last
        if n:
            yield made(pa.Table.from_batches(held))

    ordered = bars.select("symbol", "ts", *(F.col(c).cast("double").alias(c) for c in used))
    # A window orders rows within their symbol and shuffles only those that do not lie by symbol yet.
    ordered = ordered.withColumn("_place", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in out)
    return ordered.mapInArrow(run, schema)
