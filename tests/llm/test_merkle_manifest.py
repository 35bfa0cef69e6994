from __future__ import annotations

import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from barloom.llm import merkle_manifest as op

from .helpers import SCHEMA, clashing, empty, odd, odd_rows


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 8 * 8
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def manifest(rows):
    """(doc_id, lang, leaf, subroot, root, path) of every row, by definition."""
    name = lambda r: (r[2] is not None, (r[2] or "").encode())
    trees = [(k, sorted(((r[0] is not None, r[0] or 0, leaf(*r)), r) for r in part)) for k, part in groupby(sorted(rows, key=name), key=name)]
    climbed = [climb([x[0][2] for x in tree]) for _, tree in trees]
    root, over = climb([c[0] for c in climbed])
    return [(r[0], r[2], own[2], sub, root, paths[i] + over[t]) for t, ((_, tree), (sub, paths)) in enumerate(zip(trees, climbed, strict=True)) for i, (own, r) in enumerate(tree)]


def found(df):
    return [(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], [(s["l"].decode(), s["r"].decode()) for s in r["path"]]) for r in df.collect()]


def order(rows):
    return sorted(rows, key=str)


def docs_of(n: int, langs: list):
    return [(i, f"Text {i} ß", langs[i * i % len(langs)], "s", i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 70, 1200])
def test_equals_brute_force(spark, n):
    rows = docs_of(n, ["en", None, "de", "en", "é", "en"])
    df = op.merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert order(found(df)) == order(manifest(rows))


def test_several_rounds_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "DEEP", 1)
    monkeypatch.setattr(op, "BLOCK", 8)
    rows = docs_of(530, ["en"]) + [(1000 + i, "x", f"lang{i}", "s", 1) for i in range(70)]
    assert order(found(op.merkle_manifest(spark.createDataFrame(rows, SCHEMA)))) == order(manifest(rows))


def test_proofs_fold_to_the_root_and_show_changes(spark):
    docs = spark.createDataFrame(docs_of(100, ["en", "de"]), SCHEMA)
    rows = op.merkle_manifest(docs, {"other": F.sha2("text", 256)})
    got = rows.select("root", "leaf", "other", "path", op.folded(F.col("leaf"), F.col("path")).alias("same"), op.folded(F.col("other"), F.col("path")).alias("changed"), op.proof_digest(F.col("path")).alias("proof")).collect()
    assert all(r["same"] == r["root"] != r["changed"] for r in got)
    assert all(r["proof"] == h(*(s["l"].decode() + s["r"].decode() for s in r["path"])) for r in got)


def test_edges(spark):
    for docs in (odd(spark), clashing(spark).withColumns({c: F.lit("x") for c in ("tree", "pos", "digest", "block", "path", "root", "leaf", "g", "o", "_at", "_tie")})):
        assert order(found(op.merkle_manifest(docs))) == order(manifest(odd_rows()))
    assert op.merkle_manifest(empty(spark)).collect() == []
