"""Token ids as Arrow stream files of equal-length sequences.

Documents are range-partitioned by doc_id; each partition is one file, so the files in order hold
the ids of all documents in ascending doc_id order. A file is an Arrow IPC stream whose batches
have two fixed-size-list columns, ids and mask, of sequence_length each. Opened through a memory map, a batch is a view
of the file: sequence i is a slice of one flat buffer. The last sequence of a file is filled up with zeros that the
mask marks. Beside each file lies an index of its documents (id, start in the file, length).

A task writes under a name of its own attempt and renames at the end, so a repeated task replaces
its file whole. The manifest, one row for each file, is written once by Spark."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST_DOCS, map_arrow, partitions, shared_dir
from .wordpieces import loaded, read_tokenizer, remembered, split_words

SEQUENCE, BATCH_SEQUENCES = 2048, 256
#: Batches that a reader keeps. A table of few documents gets fewer files than there are shuffle partitions: LEAST_DOCS to a file, about.
HELD_BATCHES = 4


def _filesystem(path: str) -> tuple:
    from pyarrow import fs

    at = urlparse(path)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(at.path)
    return fs.FileSystem.from_uri(path)


def _schema(wide: bool, sequence: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class TokenFileWriter:
    """Appends documents' ids to one stream file and its index."""

    def __init__(self, filesystem, path: str, wide: bool, sequence: int = SEQUENCE):
        self.schema, self.sequence = _schema(wide, sequence), sequence
        self.type = np.dtype("<u4" if wide else "<u2")
        self.sink = filesystem.open_output_stream(path)
        self.index_sink = filesystem.open_output_stream(path + ".index")
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.index = pa.ipc.new_stream(self.index_sink, _INDEX)
        self.places_sink, self.places = filesystem.open_output_stream(path + ".places"), []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_docs = 0

    def add(self, doc_ids: list, each: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        starts = self.n_tokens + np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(each) else sizes
        self.index.write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes)], schema=_INDEX))
        self.held += [x.astype(self.type) for x in each]
        self.n_held += int(sizes.sum())
        self.n_tokens += int(sizes.sum())
        self.n_docs += len(each)
        size = self.sequence * BATCH_SEQUENCES
        if self.n_held >= size:
            flat = np.concatenate(self.held)
            whole = len(flat) // size * size
            for at in range(0, whole, size):
                self._write(flat[at : at + size], size)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, n: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:n] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (flat, mask)]
        batch = pa.record_batch(lists, schema=self.schema)
        self.stream.write_batch(batch)
        end = self.sink.tell()
        self.places.append((end - pa.ipc.get_record_batch_size(batch), end))

    def close(self) -> None:
        if self.n_held:
            rows = -(-self.n_held // self.sequence)
            flat = np.zeros(rows * self.sequence, self.type)
            flat[: self.n_held] = np.concatenate(self.held)
            self._write(flat, self.n_held)
        self.places_sink.write(np.array(self.places, "<i8").tobytes())
        for x in (self.stream, self.index, self.sink, self.index_sink, self.places_sink):
            x.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, sequence: int = SEQUENCE) -> DataFrame:
    """Write the ids of documents(doc_id, text, ...), each followed by end_id; returns the manifest.

    The manifest has part, path, n_docs, n_tokens, in the order of part. Null texts count as empty. A null
    doc_id comes before all others; rows that repeat a doc_id follow each other in the order of
    their texts. Other columns are ignored; no rows give no files."""
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    files = max(1, min(partitions(spark), -(-docs.count() // LEAST_DOCS)))
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(files, F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def write(batches):
        tokens, writer, target = loaded(source.value), None, None
        known = remembered(source.value)
        end, task = np.array([end_id], "<u4"), TaskContext.get()
        part = task.partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                filesystem, base = _filesystem(folder)
                filesystem.create_dir(base)
                target = f"{base}/part-{part:06d}.arrows"
                attempt = f"{base}/.part-{part:06d}-{task.taskAttemptId()}"
                writer = TokenFileWriter(filesystem, attempt, max(len(tokens.pieces) - 1, end_id) > 0xFFFF, sequence)
            texts = [split_words(t) if t else [] for t in batch.column(1).to_pylist()]
            get = known.of(texts).__getitem__
            writer.add(batch.column(0).to_pylist(), [np.concatenate((np.frombuffer(b"".join(map(get, words)), "<u4"), end)) for words in texts])
        if writer is not None:
            writer.close()
            for suffix in (".index", ".places", ""):
                filesystem.move(attempt + suffix, target + suffix)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([folder.rstrip("/") + "/" + target.rsplit("/", 1)[1]]), pa.array([writer.n_docs], pa.int64()), pa.array([writer.n_tokens], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    manifest = map_arrow(ordered, write, "part int, path string, n_docs long, n_tokens long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class TokenFile:
    """Random access to one file, a batch at a time. Sequences are views of the mapped file where it is local; elsewhere the last
    HELD_BATCHES batches are kept."""

    def __init__(self, path: str):
        filesystem, at = _filesystem(path)
        opened = pa.memory_map if filesystem.type_name == "local" else filesystem.open_input_file
        self.file, self._index = opened(at), lambda: opened(at + ".index")
        with filesystem.open_input_file(at + ".places") as f:
            self.places = np.frombuffer(f.read(), "<i8").reshape(-1, 2)
        self.schema = pa.ipc.read_schema(self.file)
        self.length = self.schema.field("ids").type.list_size
        self.batch = lru_cache(HELD_BATCHES)(self._read)
        self.rows = self.batch(0).num_rows if len(self.places) else 0

    def _read(self, k: int) -> pa.RecordBatch:
        start, end = self.places[k].tolist()
        self.file.seek(start)
        return pa.ipc.read_record_batch(pa.ipc.read_message(pa.BufferReader(self.file.read_buffer(end - start))), self.schema)

    def __len__(self) -> int:
        return self.rows * (len(self.places) - 1) + self.batch(len(self.places) - 1).num_rows if len(self.places) else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence i."""
        batch = self.batch(i // self.rows)
        at = (i % self.rows) * self.length
        ids, mask = (batch.column(k).values.slice(at, self.length) for k in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """n ids from position start on."""
        size, out = self.rows * self.length, []
        while n > 0:
            values = self.batch(start // size).column(0).values
            out.append(values.slice(start % size, n).to_numpy(zero_copy_only=True))
            start, n = start + len(out[-1]), n - len(out[-1])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def documents(self) -> Iterator[tuple[list, list, list, list]]:
        """ids, starts, lengths and tokens of the documents, a batch of the index at a time."""
        for whole in pa.ipc.open_stream(self._index()):
            for at in range(0, whole.num_rows, 1024):
                ids, starts, sizes = (c.to_pylist() for c in whole.slice(at, 1024).columns)
                yield ids, starts, sizes, [self.tokens(s, n) for s, n in zip(starts, sizes, strict=True)]


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of little-endian
    unsigned 32-bit ids) of each document, read from the files. The manifest has a row for each
    file, so its running sum is made on the driver."""
    spark = manifest.sparkSession
    rows, before = [], 0
    for r in manifest.orderBy("part").collect():
        rows.append((len(rows), r.path, before))
        before += r.n_tokens
    files = spark.createDataFrame(rows, "part int, path string, before long").repartitionById(max(1, len(rows)), F.col("part"))

    def read(batches):
        for batch in batches:
            for path, offset in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for ids, starts, sizes, each in TokenFile(path).documents():
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in each]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s + offset for s in starts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(files, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
