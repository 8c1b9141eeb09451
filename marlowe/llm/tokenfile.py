"""Token ids as Arrow IPC files of fixed-size-list batches, for zero-copy random access to equal-length sequences.

A data set is a folder of shards in ascending document order. A shard ``shard-*.arrow`` is an Arrow IPC file; each
row is one sequence of exactly ``length`` ids and a mask of as many bits, and all batches but the last
have ``rows`` rows, so sequence k is row k % rows of batch k // rows. The documents' ids lie end to end; only the
shard's last sequence is padded. ``shard-*.index.arrow`` says where each document lies. Files get names of their own
for each task attempt and a task's manifest row names the file it has closed, so a lost executor or a second attempt
leaves a stray file, never a wrong one.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlowe.llm import common
from marlowe.llm.pretokens import default_path, shared

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard INT, path STRING, n_docs BIGINT, n_tokens BIGINT, length INT, rows INT"


def schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("attention_mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Cuts the running ids into sequences and writes a batch whenever it is full."""

    def __init__(self, fs, path: str, length: int, rows: int, wide: bool):
        self.schema, self.length, self.rows, self.dtype = schema(length, wide), length, rows, np.uint32 if wide else np.uint16
        self.out = fs.open_output_stream(f"{path}.arrow")
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.index_out = fs.open_output_stream(f"{path}.index.arrow")
        self.index = pa.ipc.new_file(self.index_out, INDEX)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0
        self.entries: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.entries.append((doc_id, self.n_tokens, ids.size))
        self.n_tokens, self.n_docs, self.n_held = self.n_tokens + ids.size, self.n_docs + 1, self.n_held + ids.size
        self.held.append(ids.astype(self.dtype))
        if self.n_held >= self.length * self.rows:
            self.flush(False)
        if len(self.entries) >= 50_000:
            self.flush_index()

    def flush(self, end: bool) -> None:
        ids, full = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype), self.length * self.rows
        at = 0
        while ids.size - at >= full or end and at < ids.size:
            part = ids[at : at + full]
            n = -(-part.size // self.length)
            padded = np.zeros(n * self.length, self.dtype)
            padded[: part.size] = part
            self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length), pa.FixedSizeListArray.from_arrays(pa.array(np.arange(padded.size) < part.size), self.length)], schema=self.schema))
            at += part.size
        self.held, self.n_held = [ids[at:]], ids.size - at

    def flush_index(self) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array([e[i] for e in self.entries], pa.int64()) for i in range(3)], schema=INDEX))
        self.entries = []

    def close(self) -> None:
        self.flush(True)
        self.flush_index()
        for x in (self.file, self.out, self.index, self.index_out):
            x.close()


class ShardReader:
    """Random access to a shard's documents and sequences; of a local file the pages are mapped, not copied."""

    def __init__(self, fs, path: str, length: int, rows: int):
        local = isinstance(fs, pafs.LocalFileSystem)
        opened = [pa.memory_map(f"{path}{x}") if local else fs.open_input_file(f"{path}{x}") for x in (".arrow", ".index.arrow")]
        self.file, self.index, self.length, self.rows = pa.ipc.open_file(opened[0]), pa.ipc.open_file(opened[1]), length, rows
        self.last: tuple[int, pa.RecordBatch | None] = (-1, None)

    def batch(self, k: int) -> pa.RecordBatch:
        if self.last[0] != k:
            self.last = (k, self.file.get_batch(k))
        return self.last[1]

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and the mask (true for an id, false for padding) of the k-th sequence: views of the file's pages, not copies.

        The mask stays an Arrow array, as numpy has no bits; as bytes it would take half as much again as the ids.
        """
        batch, at = self.batch(k // self.rows), k % self.rows * self.length
        return batch.column(0).flatten().to_numpy(zero_copy_only=True)[at : at + self.length], batch.column(1).flatten().slice(at, self.length)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, in pieces of a batch at most."""
        full = self.length * self.rows
        while n:
            k, at = divmod(start, full)
            piece = self.batch(k).column(0).flatten().to_numpy()[at : at + n]
            yield piece
            start, n = start + piece.size, n - piece.size

    def documents(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)


def write(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, length: int = 2048, rows: int = 64) -> DataFrame:
    """Encodes all texts, adds ``end_id`` to each, writes the shards to ``folder`` and returns the manifest.

    Shards and the documents in them ascend by id, null ids first; of equal ids, the texts' hashes decide, so repeated
    rows keep a row each. Null and empty texts are one ``end_id``. An empty table gives an empty manifest. Ids are cast to
    long; columns beyond id and text are left out. Partitions are dealt by ranges of id and text hash, so a repeated id
    or many nulls spread over several.
    """
    spark, path = docs.sparkSession, path or default_path()
    plain = common.pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("tie", F.xxhash64("text"))
    ordered = plain.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("tie").asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("tie").asc())

    def run(batches):
        out, name, tok, fs = None, "", None, None
        for batch in batches:
            if batch.num_rows and out is None:
                fs, root = pafs.FileSystem.from_uri(folder)
                shard = TaskContext.get().partitionId()
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
                fs.create_dir(root, recursive=True)
                tok = shared(path)
                out = ShardWriter(fs, f"{root}/{name}", length, rows, tok.tok.get_vocab_size() > 1 << 16)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out.add(doc_id, np.append(tok.encode(text.as_py()), np.uint32(end_id)))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([out.n_docs]), pa.array([out.n_tokens]), pa.array([length], pa.int32()), pa.array([rows], pa.int32())], names=["shard", "path", "n_docs", "n_tokens", "length", "rows"])

    ordered.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document, from the files: doc_id, start (ids before it in the data set), n_tokens, ids_crc32, n_sequences of its shard."""
    manifest = spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()  # a row for each file
    total, shards = 0, []
    for m in manifest:
        shards.append((m["path"], total, m["length"], m["rows"]))
        total += m["n_tokens"]
    files = spark.createDataFrame(shards, "path STRING, base BIGINT, length INT, rows INT").repartition(max(1, len(shards)))

    def run(batches):
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for f in batch.to_pylist():
                fs, root = pafs.FileSystem.from_uri(folder)
                shard = ShardReader(fs, f"{root}/{f['path']}", f["length"], f["rows"])
                for docs in shard.documents():
                    crc = []
                    for start, n in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                        c = 0
                        for piece in shard.tokens(start, n):
                            c = zlib.crc32(piece.astype("<u4").tobytes(), c)
                        crc.append(c)
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(docs.column(1).to_numpy() + f["base"]), docs.column(2), pa.array(crc, pa.int64())], names=names)

    return files.mapInArrow(run, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT")
