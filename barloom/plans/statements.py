"""Queries as one SQL statement over named sources."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.layers import Source, duck_text, spark_text
from barloom.sources.bars import read


def table(name: str, columns: str = "*") -> Source:
    """A given table, or a projection of it."""
    return Source(lambda spark, sf_dir: read(spark, sf_dir, name).selectExpr(*_split(columns)), f"SELECT {columns} FROM {name}")


def _split(columns: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[last:i].strip())
            last = i + 1
    return [*out, columns[last:].strip()]


@dataclass(frozen=True)
class Statement:
    """text names its sources as {name}; `other` replaces text in the checking dialect, `oracle` is a statement of its own."""

    text: str
    sources: dict[str, Source]
    other: dict[str, str] = field(default_factory=dict)
    oracle: str = ""

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {n: s.frame(spark, sf_dir) for n, s in self.sources.items() if f"{{{n}}}" in self.text}
        return spark.sql(spark_text(self.text), **used)

    def sql(self) -> str:
        text = self.oracle or duck_text(self.text)
        for a, b in self.other.items():
            text = text.replace(a, b)
        return re.sub(r"\{(\w+)\}", lambda m: f"({self.sources[m[1]].sql})", text)
