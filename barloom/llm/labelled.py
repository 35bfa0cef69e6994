"""A bounded sample of labelled rows for fitting; nothing else is sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, bound: dict[int, int]) -> DataFrame:
    """Rows of docs with `label` (0 or 1), at most bound[v] of value v, those whose ids hash lowest. Held-out rows, null
    labels and null texts are left out. An id with both labels counts as 1; so do equal texts with both, of which the row
    with the smallest id stays: the sample is the same in every run. The ids are few enough to broadcast: sum(bound)."""
    known = labels.where(F.col(label).isin(*bound) & F.col("doc_id").isNotNull()).where(~held_out).groupBy("doc_id").agg(F.max(label).alias(label))
    some = None
    for value, most in bound.items():
        part = known.where(F.col(label) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = part if some is None else some.unionByName(part)
    picked = docs.where("text is not null").join(F.broadcast(cut(some, "picked")), "doc_id")
    others = [c for c in picked.columns if c not in (label, "text")]
    least = picked.groupBy("text").agg(F.max(label).alias(label), F.min(F.struct("doc_id", *(c for c in others if c != "doc_id"))).alias("_least"))
    return cut(least.select("_least.*", "text", label), "labelled")
