"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate as benchmark
from barloom.llm import toxicity as lexicon
from barloom.llm.common import cut, documents, held_out, new_folder
from barloom.llm.minhash_dedup import near_duplicates
from barloom.llm.packing import pack
from barloom.llm.quality_rules import quality_rules

TOKENIZER = "byte_bpe_50k.json"
TOXIC_SCORE = 0.5


def _beside(docs: DataFrame, *read: str) -> DataFrame:
    """The columns that an operator reads, and all others inside one struct, where no column it adds can meet them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in read]
    return docs.select(*read, F.struct(*others).alias("_others") if others else F.lit(None).alias("_others"))


def _restored(judged: DataFrame, docs: DataFrame, *read: str) -> DataFrame:
    """The columns of docs, in their order."""
    return judged.select(*(F.col(c) if c in read else F.col(f"_others.`{c}`") for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The lexicon is learned from the labelled documents of the stage.

    Null, empty and wordless texts are not toxic and stay; very long texts are scored whole; repeated rows fare alike;
    an empty table stays empty; columns with names that the operator adds keep their own values."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fitted = lexicon.fit(docs, labels, held_out(F.col("doc_id"), 5, 0))
    return _restored(lexicon.score_toxicity(_beside(docs, "text"), fitted).where(F.col("score") < TOXIC_SCORE), docs, "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from the text (n_chars follows), and rejected documents go whole.

    Null, empty and short texts fail the base rule and go; very long texts are judged whole; repeated rows fare alike;
    an empty table stays empty; columns with names that the operator adds keep their own values."""
    kept = quality_rules(_beside(docs, "text", "n_chars")).where("kept")
    n_chars = F.when(F.col("n_lines_failed") == 0, F.col("n_chars")).otherwise(F.length("clean_text").cast(docs.schema["n_chars"].dataType))
    return _restored(kept.withColumns({"n_chars": n_chars, "text": F.col("clean_text")}), docs, "text", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id. Documents without an id stay.

    Rows of one id and one text are one document, of which the row stays whose other columns, as JSON, hash lowest; rows of
    one id with different texts stay or go together. Null and wordless texts are in no group and stay; an empty table stays
    empty; very long texts are compared whole; columns with names that the operator adds, of any type, keep their own
    values."""
    by_id = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    gone = cut(by_id.where("not kept").select("doc_id"), "gone")
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    rows = _beside(docs, "doc_id", "text").join(gone, "doc_id", "left_anti")
    if not twice.isEmpty():
        others = len(docs.columns) > 2
        least = F.min_by("_others", F.xxhash64(F.to_json("_others"))) if others else F.first("_others")
        one = rows.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(least.alias("_others"))
        rows = rows.join(twice, "doc_id", "left_anti").unionByName(one)
    return _restored(rows, docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null, empty and wordless texts hold none and stay; very long texts are scanned whole; repeated rows fare alike; an
    empty table stays empty; columns with names that the operator adds keep their own values."""
    found = benchmark.decontaminate(_beside(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _restored(found.where("not contaminated"), docs, "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences: null texts are one end id, very long ones several pieces, repeated rows
    are packed each for itself, an empty table gives none, other columns are not read."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxicity), ("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL has no tokenizer and no Aho-Corasick lexicon; tests/llm holds the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_folder(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
