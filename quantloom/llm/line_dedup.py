"""Line de-duplication that returns keep bitmaps.

Every line becomes a 128-bit hash of its key. Hashes are dealt out by range, sorted by (hash,
document, position) and streamed: only the first document that holds a hash keeps its lines. The
result is a compressed bitmap for each document, never text.

Skew: the few most frequent keys (at most HEAVY of them, so their table has a fixed size) are
decided in the scan by a broadcast table of first documents and never enter the exchange. Any
other key has at most 1/HEAVY of all lines, or HEAVY_ROWS."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, map_arrow, packed, partitions, text_tag

#: Keys in the broadcast table at most, and the lines that make a key worth a place there.
HEAVY, HEAVY_ROWS = 10_000, 1_000
MIN_POINTS = 10

_LINES = "pid int, h binary, doc_id long, tag long, pos int, n_lines int"
_LINES_ARROW = pa.schema([("pid", pa.int32()), ("h", pa.binary()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])


def line_keys(text: str | None, min_points: int = MIN_POINTS) -> Iterator[tuple[int, bytes]]:
    """(position, hash) of the lines whose key has min_points code points at least."""
    for i, line in enumerate((text or "").split("\n")):
        key = line.strip(WHITE)
        if len(key) >= min_points:
            yield i, xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())


def _rank(doc_id: int | None) -> tuple[bool, int]:
    """Null is the smallest id, as in Spark's ascending order."""
    return doc_id is not None, doc_id or 0


def _key_counts(docs: DataFrame, min_points: int) -> DataFrame:
    """(h, n, first, last) with a partial sum in each task, so a frequent key is one row of each."""

    def partial(batches):
        for batch in batches:
            found: dict[bytes, list] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for _, h in line_keys(text, min_points):
                    x = found.get(h)
                    if x is None:
                        found[h] = [1, doc_id, doc_id]
                    else:
                        x[0] += 1
                        x[1], x[2] = min(x[1], doc_id, key=_rank), max(x[2], doc_id, key=_rank)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), *(pa.array([x[k] for x in found.values()], pa.int64()) for k in range(3))], names=["h", "n", "first", "last"])

    rows = map_arrow(docs, partial, "h binary, n long, first long, last long")
    lo, hi = F.min(F.struct(F.col("first").isNotNull().alias("a"), F.col("first").alias("b"))), F.max(F.struct(F.col("last").isNotNull().alias("a"), F.col("last").alias("b")))
    return rows.groupBy("h").agg(F.sum("n").alias("n"), lo["b"].alias("first"), hi["b"].alias("last"))


def line_dedup(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Keep bitmaps of the lines of documents(doc_id, text, ...).

    Returns doc_id, tag (crc32 of the text, which tells rows of the same doc_id apart), n_lines,
    n_dropped and keep (zlib of the packed bits, 1 = line stays), a row for each different
    (doc_id, tag). A key is the line stripped of white space and with A-Z lower-cased; a key of
    min_points code points or more that at least two doc_ids hold stays only in the smallest, with
    all its lines there. Null and empty texts have one empty line. A null doc_id counts as one id,
    smaller than all others. Rows that repeat a doc_id count as one document when documents
    holding a key are counted. Other columns are ignored; no rows give no rows."""
    spark, n_parts = docs.sparkSession, partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    top = _key_counts(docs, min_points).where((F.col("n") > HEAVY_ROWS) & ~F.col("first").eqNullSafe(F.col("last"))).orderBy(F.desc("n"), "h").limit(HEAVY)
    heavy = spark.sparkContext.broadcast({bytes(r.h): r.first_id for r in top.select("h", F.col("first").alias("first_id")).collect()})

    def lines(batches):
        """A row for each line in question, for each line dropped (h null) and for each document (pos -1)."""
        firsts = heavy.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tag = text_tag(text)
                near = ((doc_id or 0) + tag) % n_parts
                out.append((near, None, doc_id, tag, -1, (text or "").count("\n") + 1))
                for pos, h in line_keys(text, min_points):
                    if h not in firsts:
                        out.append((int.from_bytes(h[:4]) * n_parts >> 32, h, doc_id, tag, pos, None))
                    elif firsts[h] != doc_id:
                        out.append((near, None, doc_id, tag, pos, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _LINES_ARROW.types, strict=True)] if out else [pa.array([], t) for t in _LINES_ARROW.types], schema=_LINES_ARROW)

    def first_only(batches):
        """Of the sorted rows: those of documents and dropped lines as they are, later documents' lines as dropped."""
        last, first = None, None
        for batch in batches:
            hs, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keep = np.ones(len(hs), bool)
            for i, h in enumerate(hs):
                if h is None:
                    continue
                if h != last:
                    last, first = h, ids[i]
                keep[i] = ids[i] != first
            yield batch.filter(pa.array(keep)).select([2, 3, 4, 5])

    dealt = map_arrow(docs, lines, _LINES).repartitionById(n_parts, F.col("pid")).sortWithinPartitions("h", "doc_id", "tag", "pos")
    rows = map_arrow(dealt, first_only, "doc_id long, tag long, pos int, n_lines int")
    by_doc = rows.groupBy("doc_id", "tag").agg(F.max("n_lines").alias("n_lines"), F.collect_set(F.when(F.col("pos") >= 0, F.col("pos"))).alias("dropped"))

    def bitmaps(batches):
        for batch in batches:
            keeps = []
            for n, dropped in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                bits = np.ones(n, bool)
                bits[dropped] = False
                keeps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            n_dropped = pc.list_value_length(batch.column(3)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), n_dropped, pa.array(keeps, pa.binary())], names=["doc_id", "tag", "n_lines", "n_dropped", "keep"])

    return map_arrow(by_doc, bitmaps, "doc_id long, tag long, n_lines long, n_dropped long, keep binary")


def _cut(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """rows(doc_id, text, rest) with text reduced to the lines that stay, n_lines and n_dropped."""
    left = rows.withColumn("tag", F.when(F.col("text").isNull(), 0).otherwise(F.crc32(F.encode("text", "utf-8"))))
    right = bitmaps.select(F.col("doc_id").alias("id"), F.col("tag").alias("tag2"), "n_lines", "n_dropped", F.when(F.col("n_dropped") > 0, F.col("keep")).alias("keep"))
    joined = left.join(right, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("tag2")), "left").select("doc_id", "text", "rest", "n_lines", "n_dropped", "keep")

    def kept(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, bits in enumerate(batch.column(5).to_pylist()):
                if bits is not None and texts[i] is not None:
                    lines = texts[i].split("\n")
                    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
                    texts[i] = "\n".join([x for x, b in zip(lines, keep.tolist(), strict=True) if b])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == 1 else batch.column(i) for i in range(5)], names=batch.schema.names[:5])

    return map_arrow(joined, kept, joined.drop("keep").schema)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with text reduced to the lines that stay, and the columns n_lines and n_dropped.

    A document without a bitmap stays as it is. Null texts stay null. Columns of docs keep their
    names, values and order; only n_lines and n_dropped replace columns of these names."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows, _ = packed(docs.select(*(F.col(f"`{c}`") for c in names)))
    return _cut(rows, bitmaps).select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in names), "n_lines", "n_dropped")


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that an earlier document holds, with their columns, whatever the names."""
    rows, back = packed(docs)
    return back(_cut(rows, line_dedup(docs)))
