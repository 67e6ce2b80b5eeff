"""Helpers shared by the training-data operators: words, packing, chunks and the shared folder."""

from __future__ import annotations

import ctypes
import re
import struct
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D, what bytes.split() splits at.
WHITE = " \t\n\x0b\x0c\r"
#: Documents of a chunk, which share a lookup table, at most, and of a range at least, about.
CHUNK_DOCS, LEAST_DOCS = 4096, 2048
#: Rows of a batch that an operator sees at a time.
BATCH_ROWS = 512
#: Stands for a null doc_id, which is the smallest.
NO_ID = -(1 << 63)
#: Longs in a bit filter: 2 MB. Far beyond its 16 million bits it only stops saving.
FILTER_WORDS = 1 << 18
#: Bytes of text in one packed row at most (a longer document is a row of its own).
PACK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the setting is absent a local master gets a temporary
    folder; on a cluster that would be a folder of one machine, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the written rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows through Spark's file system layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch on Spark's side, since a row may hold a text of over 100 kB.

    Plans read the setting when they run, so it holds for the rest of the session; a smaller one stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def free_memory() -> None:
    """Memory that the task has freed goes back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def _trimmed(out: Iterator) -> Iterator:
    try:
        yield from out
    finally:
        free_memory()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow whose batches are handed on in slices of so many rows, since a row may hold a text of over 100 kB."""

    def sliced(batches):
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), rows):
                yield batch.slice(at, rows)

    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: _trimmed(fn(sliced(batches))), schema)


def _bits(key: Column) -> tuple[Column, Column]:
    """The place of a value in a bit filter: the number of its long, and its bit there."""
    h = F.xxhash64(key)
    return F.pmod(F.shiftrightunsigned(h, 6), F.lit(FILTER_WORDS)).cast("int"), F.pmod(h, F.lit(64)).cast("int")


def may_hold(values: DataFrame, key: Column) -> Column:
    """Whether the only column of values may hold key, by a bit filter of FILTER_WORDS longs: false is certain.

    Both are longs. What passes is then joined, which is exact; all else need not meet anything. A null may pass."""
    at, bit = _bits(F.col(values.columns[0]))
    words = values.groupBy(at.cast("long").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    full = values.sparkSession.range(FILTER_WORDS).select(F.col("id").alias("at")).join(words, "at", "left").select("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    longs = full.agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).alias("s")).select(F.transform("s", lambda x: x["bits"]).alias("f"))
    at, bit = _bits(key)
    return F.coalesce(F.getbit(F.get(longs.scalar(), at), bit) == 1, F.lit(False))


def free_name(base: str, columns: list[str]) -> str:
    """base, with underscores behind it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def packed(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(doc_id, text, rest) of docs, and the way back from rows with text and rest to the columns of docs.

    rest holds every other column, so whatever their names are they can't meet an operator's own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(F.lit(0).alias(free_name("_", others)), *(F.col(f"`{c}`") for c in others))

    def back(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns))

    return docs.select("doc_id", "text", rest.alias("rest")), back


def as_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_tag(text: str | None) -> int:
    """Tells rows apart that repeat a doc_id with another text; 0 for null."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) if text is not None else 0


def text_tags(texts: list[str | None], tagged: bool = True) -> list[int]:
    return [text_tag(t) for t in texts] if tagged else [0] * len(texts)


def pack(items: list[bytes]) -> bytes:
    """Byte strings as one compressed value."""
    lengths = np.fromiter(map(len, items), "<u4", len(items))
    raw = struct.pack("<I", len(items)) + lengths.tobytes() + b"".join(items)
    return zstandard.ZstdCompressor(level=5).compress(raw)


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    out, start = [], 4 + 4 * n
    for end in ends.tolist():
        out.append(raw[start:end])
        start = end
    return out


class Placement:
    """Where documents meet: ranges of doc_id with about as many documents each, one for each partition (fewer
    where a range would have under LEAST_DOCS), cut into chunks of CHUNK_DOCS documents at most, about.

    The tag of a row (0, or a checksum of its text) spreads rows that share an id, null included: an id that
    fills several ranges goes to all of them. The bounds are one number a partition, so they fit the driver."""

    def __init__(self, bounds: list[int], parts: int):
        self.bounds, self.parts = np.array(sorted(bounds), np.int64), parts
        self.ranges = len(bounds) + 1

    def chunks(self, ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The chunk of each row; null ids are given as NO_ID."""
        lo, hi = np.searchsorted(self.bounds, ids, "left"), np.searchsorted(self.bounds, ids, "right")
        tags = tags.astype(np.int64)
        part = np.where(hi > lo, lo + 1 + tags % np.maximum(hi - lo, 1), lo)
        mixed = (ids.view(np.uint64) + tags.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
        return part * self.parts + (mixed >> np.uint64(33)).astype(np.int64) % self.parts

    def of(self, ids: list[int | None], tags: list[int]) -> np.ndarray:
        return self.chunks(np.array([NO_ID if i is None else i for i in ids], np.int64), np.array(tags, np.int64))


def placement(docs: DataFrame) -> Placement:
    """The placement of docs(doc_id, ...), from their number and approximate quantiles: two scans of the ids."""
    rows = docs.count()
    n = max(1, min(partitions(docs.sparkSession), -(-rows // LEAST_DOCS)))
    if n == 1:
        return Placement([], max(1, -(-rows // CHUNK_DOCS)))
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    bounds = docs.agg(F.percentile_approx(ids, [(k + 1) / n for k in range(n - 1)], max(10_000, 20 * n)).alias("bounds")).first().bounds
    return Placement(bounds, -(-rows // (n * CHUNK_DOCS)))


#: Rows that meet by chunk: kind 0 is a part of the lookup table, kind 1 a pack of documents.
CHUNK_ROWS = "chunk long, kind int, ids array<long>, data binary"
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())), ("data", pa.binary())])


def chunked_docs(docs: DataFrame, place: Placement, tagged: bool = True) -> DataFrame:
    """Documents as compressed packs by chunk: a text crosses the network at less than half its size.

    A leading byte tells a null text (0) from an empty one (1)."""

    def packs(batches):
        for batch in batches:
            groups: dict[int, tuple[list, list]] = {}
            sizes: dict[int, int] = {}
            rows = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for c, doc_id, text in zip(place.of(ids, text_tags(texts, tagged)).tolist(), ids, texts, strict=True):
                held, items = groups.setdefault(c, ([], []))
                held.append(doc_id)
                items.append(b"\0" if text is None else b"\1" + text.encode("utf-8", "surrogatepass"))
                sizes[c] = sizes.get(c, 0) + len(items[-1])
                if sizes[c] >= PACK_BYTES:
                    rows.append((c, held, pack(items)))
                    del groups[c], sizes[c]
            rows += [(c, held, pack(items)) for c, (held, items) in groups.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([1] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary())],
                schema=CHUNK_SCHEMA,
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), packs, CHUNK_ROWS)


def unpack_docs(ids: list[int | None], data: bytes) -> Iterator[tuple[int | None, str | None]]:
    for doc_id, item in zip(ids, unpack(data), strict=True):
        yield doc_id, item[1:].decode("utf-8", "surrogatepass") if item[:1] == b"\1" else None


def meet_by_chunk(lookup: DataFrame, docs: DataFrame, place: Placement, tagged: bool = True) -> DataFrame:
    """Lookup rows and packed documents of a chunk in one task, the lookup rows first."""
    both = lookup.unionByName(chunked_docs(docs, place, tagged))
    return both.repartitionById(place.ranges, F.floor(F.col("chunk") / place.parts).cast("int")).sortWithinPartitions("chunk", "kind")


def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, bytes]]:
    """(chunk, kind, ids, data) in the order of meet_by_chunk."""
    for batch in batches:
        chunk, kind, ids, data = batch.columns
        for i in range(batch.num_rows):
            yield chunk[i].as_py(), kind[i].as_py(), ids[i].as_py(), data[i].as_py()
