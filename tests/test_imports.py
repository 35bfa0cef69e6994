"""Imports, the data set sink, feature alignment and clusters on small tables."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators.clusters import correlation_clusters, linked_groups
from barloom.operators.learning import FEATURES, aligned, fitted, inferred
from barloom.plans import registry
from barloom.sources import files


def test_imports_refuse_and_keep_one(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "action_id,symbol,action_type,status,effective_date,cash_amount,ratio\n"
        "x1, thyao ,split,confirmed,2024-03-01,,2\nx2,THYAO,SPLIT,confirmed,2024-03-01,,2\n"
        "x3,GARAN,DIVIDEND,confirmed,2024-02-30,1.5,\nx4,,SPLIT,confirmed,2024-04-01,,3\nx5,GARAN,DIVIDEND,confirmed,2024-05-02,1.5,\n"
    )
    good, refused = files.read_records(spark, f"{tmp_path}/a.csv", "corporate_actions")
    assert {(r["action_id"], r["symbol"], r["ratio"], r["cash_amount"]) for r in good.collect()} == {("x1", "THYAO", 2.0, None), ("x5", "GARAN", None, 1.5)}
    assert {(r["action_id"], tuple(r["faults"])) for r in refused.collect()} == {("x3", ("effective_date",)), ("x4", ("symbol",))}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "one.json").write_text('[{"event_id": "1", "event_type": "earnings", "event_date": "2024-05-01"}, {"event_id": "2", "event_type": "earnings"}]')
    good, refused = files.read_records(spark, f"{tmp_path}/e/one.json", "events")
    assert [(r["event_type"], r["symbol"]) for r in good.collect()] == [("EARNINGS", None)] and [r["event_id"] for r in refused.collect()] == ["2"]


def test_dataset_in_every_format(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "train"), (2, 1.5, "test"), (3, None, "train")], "k long, x double, part string")
    places = files.write_dataset(rows, str(tmp_path), ("parquet", "csv", "json"))
    for kind in ("parquet", "csv", "json"):
        back = spark.read.format(kind).schema(rows.schema).options(header=True).load(places[kind])
        assert {tuple(r) for r in back.select("k", "x", "part").collect()} == {tuple(r) for r in rows.collect()}
        assert {r["k"] for r in spark.read.format(kind).schema("k long, x double").options(header=True).load(f"{places[kind]}/part=test").collect()} == {2}
    assert {r["column"]: r["type"] for r in spark.read.json(places["schema"]).collect()} == dict(rows.dtypes)
    with pytest.raises(ValueError, match="empty"):
        files.write_dataset(rows.where("k > 9"), str(tmp_path))


def test_inference_aligns_foreign_tables(spark):
    draw = random.Random(3)
    data = [(i, *(draw.gauss(0, 1) for _ in FEATURES)) for i in range(120)]
    df = spark.createDataFrame(data, ", ".join(["k long", *(f"{c} double" for c in FEATURES)])).withColumn("label", (F.col("ret_1") + F.col("ret_5") > 0).cast("double"))
    model = fitted(df)
    own = {r["k"]: r["prediction"] for r in model.transform(df).collect()}
    foreign = df.select(*(F.col(c).cast("string").alias(c) for c in reversed(FEATURES)), "k", F.lit("x").alias("other"))
    rows = inferred(model, foreign, FEATURES, ("k",)).collect()
    assert {r["k"]: float(r["prediction"]) for r in rows} == own and {r["filled"] for r in rows} == {0}
    assert {r["filled"] for r in inferred(model, foreign.drop("ret_5"), FEATURES, ("k",), missing=True).collect()} == {1}
    with pytest.raises(ValueError, match="lacks"):
        aligned(foreign.drop("ret_5"), FEATURES)
    with pytest.raises(ValueError, match="not know"):
        aligned(foreign, FEATURES, ("k",), extra=False)


def test_clusters_equal_a_walk(spark):
    draw = random.Random(8)
    pairs = [(a, b, round(draw.uniform(-1, 1), 3)) for a, b in itertools.combinations(range(40), 2)]
    pairs += [(i, i + 1, 0.99) for i in range(100, 160)]
    df = spark.createDataFrame(pairs, "a long, b long, correlation double")
    near, want = {}, {}
    for a, b, c in pairs:
        if abs(c) >= 0.96:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in want:
                want[node] = start
                todo += near[node]
    weights = spark.range(200).selectExpr("id as symbol", "id / 1000.0D as weight").where("symbol <> 101")
    rows = correlation_clusters(df, weights, 0.96).collect()
    assert {r["symbol"]: r["cluster"] for r in rows} == want and len(rows) == len(want)
    long = next(r for r in rows if r["cluster"] == 100)
    assert long["symbols"] == 61 and long["weight"] == pytest.approx(sum(range(100, 161)) / 1000 - 0.101)
    assert linked_groups(df.where("a < 0")).count() == 0


def test_hosts_are_linked_to_numbered_instruments_only(spark, tmp_path):
    tables = {
        "documents": spark.createDataFrame([(1, "a@mail0.org and b@mail5.org"), (2, "c@Mail5.org")], "doc_id long, text string"),
        "supplier": spark.createDataFrame([(0, "none", 1, 1.0), (5, "five", 1, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": spark.createDataFrame([(1, "n", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": spark.createDataFrame([(1, "ASIA")], "r_regionkey int, r_name string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert [tuple(r) for r in registry.QUERIES["f12_linked_entities"](spark, str(tmp_path)).collect()] == [(5, "ASIA", 2)]
