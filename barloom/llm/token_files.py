"""Token ids as Arrow IPC files of fixed-size-list batches: equal sequences and masks that are read without a copy."""

from __future__ import annotations

import posixpath
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import cut, new_folder, small_batches
from barloom.llm.tokens import piece_ids

SEQUENCE = 1024  #: ids of a sequence
BATCH_SEQUENCES = 64
SMALL_VOCABULARY = 1 << 16  #: ids below take two bytes


def schema_for(vocabulary: int) -> pa.Schema:
    """ids and mask have SEQUENCE values in every row; the mask is false on padding. docs are the documents that end in
    the row, ends the places of their last ids."""
    kind = pa.uint16() if vocabulary <= SMALL_VOCABULARY else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE)), ("docs", pa.list_(pa.int64())), ("ends", pa.list_(pa.uint16()))])


class SequenceWriter:
    """Appends documents to one file; a batch leaves memory as soon as it is full."""

    def __init__(self, sink, vocabulary: int):
        self.schema = schema_for(vocabulary)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.ids, self.ends, self.docs, self.tokens, self.documents = bytearray(), [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids += ids
        self.ends.append(len(self.ids) // 4 - 1)
        self.docs.append(doc_id)
        self.tokens += len(ids) // 4
        self.documents += 1
        self._flush(len(self.ids) // (4 * SEQUENCE * BATCH_SEQUENCES) * BATCH_SEQUENCES)

    def _flush(self, sequences: int) -> None:
        if not sequences:
            return
        size = sequences * SEQUENCE
        own = np.frombuffer(bytes(self.ids[: 4 * size]), "<u4")
        ids, mask = np.zeros(size, self.schema.field("ids").type.value_type.to_pandas_dtype()), np.arange(size) < len(own)
        ids[: len(own)] = own
        n = int(np.searchsorted(self.ends, len(own)))
        ends = np.array(self.ends[:n], np.int64)
        at = pa.array(np.searchsorted(ends, np.arange(0, size + 1, SEQUENCE)).astype(np.int32))
        docs, places = pa.array(self.docs[:n], pa.int64()), pa.array((ends % SEQUENCE).astype(np.uint16))
        fixed = [pa.FixedSizeListArray.from_arrays(pa.array(x), SEQUENCE) for x in (ids, mask)]
        batch = pa.RecordBatch.from_arrays([*fixed, pa.ListArray.from_arrays(at, docs), pa.ListArray.from_arrays(at, places)], schema=self.schema)
        for k in range(0, sequences, BATCH_SEQUENCES):  # all batches but the last have BATCH_SEQUENCES rows
            self.writer.write_batch(batch.slice(k, BATCH_SEQUENCES))
        del self.ids[: 4 * size], self.docs[:n]
        self.ends = [e - size for e in self.ends[n:]]

    def close(self) -> None:
        self._flush(-(-len(self.ids) // (4 * SEQUENCE)))
        self.writer.close()


def open_sequences(path: str) -> pa.ipc.RecordBatchFileReader:
    """A reader over the file; a local file is memory-mapped."""
    store, name = pafs.FileSystem.from_uri(path)
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(name))


def sequence_at(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of the i-th sequence of a file: views of its bytes, without a copy where the file is mapped."""
    batch, row = reader.get_batch(i // BATCH_SEQUENCES), i % BATCH_SEQUENCES
    ids, mask = (batch.column(c).slice(row, 1).flatten() for c in (0, 1))
    return ids.to_numpy(zero_copy_only=True), mask


def read_documents(path: str):
    """(doc_id, ids as little-endian unsigned 32-bit bytes) of the documents of a file in order, a batch at a time."""
    reader, rest = open_sequences(path), b""
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True).astype("<u4")
        ended = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(3).offsets.to_numpy()))
        ends = ended * SEQUENCE + batch.column(3).flatten().to_numpy()
        at = 0
        for end, doc in zip(ends.tolist(), batch.column(2).flatten().to_pylist(), strict=True):
            yield doc, rest + ids[at : end + 1].tobytes()
            at, rest = end + 1, b""
        rest += ids[at : batch.column(1).flatten().true_count].tobytes()


def _write(folder: str, tokenizer_path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        table, task = piece_ids(tokenizer_path, keep_spaces=False), TaskContext.get()
        part = task.partitionId()
        store, root = pafs.FileSystem.from_uri(folder)
        name, writer = posixpath.join(root, f"part-{part:06d}.arrow"), None
        own = f"{name}.{task.taskAttemptId()}.tmp"  # a repeated attempt writes a file of its own and then takes the name
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), table.encode(batch.column("text").to_pylist()), strict=True):
                if writer is None:
                    store.create_dir(root)
                    sink = store.open_output_stream(own)
                    writer = SequenceWriter(sink, table.library.get_vocab_size())
                writer.add(doc, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            store.move(own, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/part-{part:06d}.arrow"], "documents": pa.array([writer.documents], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64())})

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes docs(doc_id, text, ...) to Arrow files under folder and returns the manifest: part, file, documents,
    tokens, start (ids in the files before). The files hold the documents by ascending doc_id, nulls first; rows of one
    id stand by text. A null text has the end id alone. No rows: no files. Extra columns are not read."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = cut(dealt.mapInArrow(_write(folder, tokenizer_path, end_id), "part int, file string, documents long, tokens long"), "manifest")
    start, files = 0, []
    for row in sorted(manifest.collect()):  # one row for each file
        files.append((*row, start))
        start += row["tokens"]
    return spark.createDataFrame(files, "part int, file string, documents long, tokens long, start long")


def _digest(batches):
    for batch in batches:
        for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            rows: list[tuple] = []
            for doc, ids in read_documents(name):
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
                start += len(ids) // 4
                if len(rows) == 10_000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), r, strict=True)) for r in rows], pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names."""
    return manifest.select("file", "start").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the files to a new shared folder and read them back."""
    return read_token_files(write_token_files(docs, new_folder(spark, "tokens"), tokenizer_path, end_id))
