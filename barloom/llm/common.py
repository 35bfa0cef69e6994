"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most, so that a batch of long texts stays small in a Python worker.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one set by setCheckpointDir. Where neither is set, local
    mode takes a temporary folder, and a cluster is refused, as its executors do not share one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest` by `mod`; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(mod)) == rest


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def text_runs(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of consecutive texts with `most` characters in all, or of one longer text; null is empty."""
    at, run, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > most:
            yield at, run
            at, run, size = i, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield at, run
