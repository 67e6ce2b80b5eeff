"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

A link is a pair of fingerprints that differ in max_bits bits at most. Fingerprints are cut into
max_bits + 3 blocks; a linked pair agrees in three blocks at least, so every choice of three blocks is a join
key. Equal fingerprints are one node from the start, so groups of exact copies cost nothing.

A key with more than PAIRS_MAX fingerprints is not paired up. There every fingerprint names itself
and all fingerprints one bit off within the blocks outside the key; two that name the same point
differ in two bits at most, and all that differ in two bits at most share a point. A point has at
most one name more than it has free bits, so the work is linear in the group and loses no link.
(This serves max_bits of 1 or 2; for others every key is paired up.)"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_arrow, may_hold, packed

SHINGLE, MAX_BITS, BITS = 3, 2, 64
#: Fingerprints under one key that are still paired up.
PAIRS_MAX = 32


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 (seed 42) values of all word shingles; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    items = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, 42) for x in items], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 majority bits of hashes; 0 for none."""
    if not len(hashes):
        return 0
    votes = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 majority bits of the XXH64 (seed 42) values of all word shingles; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row."""

    def compute(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), compute, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(max_bits: int) -> list[int]:
    """Masks of three blocks each, one of which any two linked fingerprints agree in."""
    n = max_bits + 3
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, 3)]


def links(points: DataFrame, max_bits: int = MAX_BITS, pairs_max: int = PAIRS_MAX) -> DataFrame:
    """Edges (u, v), u < v, that connect the same fingerprints as all links between them do.

    points has distinct values fp."""
    masks = block_masks(max_bits)
    keys = points.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(k))).alias("key")) for i, k in enumerate(masks)))).alias("b")).select("fp", "b.m", "b.key")
    sizes = keys.groupBy("m", "key").count().where("count > 1")
    shared = cut_lineage(keys.join(sizes, ["m", "key"]))
    few = shared if max_bits > 2 else shared.where(F.col("count") <= pairs_max)
    a, b = few.select("m", "key", F.col("fp").alias("u")), few.select("m", "key", F.col("fp").alias("v"))
    near = a.join(b, ["m", "key"]).where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)).select("u", "v")
    if max_bits > 2:
        return near.distinct()
    free = F.array(*(F.array(F.lit(0), *(F.lit(_signed(1 << i)) for i in range(BITS) if not k >> i & 1)).cast("array<bigint>") for k in masks))
    many = shared.where(F.col("count") > pairs_max).select("m", "key", "fp", F.explode(free[F.col("m")]).alias("bit"))
    points_named = many.select("m", "key", F.col("fp").bitwiseXOR(F.col("bit")).alias("point"), "fp").groupBy("m", "key", "point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    spokes = points_named.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u < v")
    if max_bits == 1:
        spokes = many.alias("x").select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("v")).join(points.select(F.col("fp").alias("v")), "v").select(F.least("fp", "v").alias("u"), F.greatest("fp", "v").alias("v")).where("u < v")
    return near.unionByName(spokes).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges(u, v); root is the smallest node it is connected with.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each written to the shared
    checkpoint folder; only counts come to the driver."""
    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Fingerprint and component of each row of documents(doc_id, text, ...).

    Returns doc_id, fp (long), component_id: the smallest doc_id reachable over links, its own
    included. Texts without words and null texts have fingerprint 0 and link like any other. Rows
    that repeat a doc_id each get a row; a null doc_id takes part but never is a component_id
    unless the component has no other. Other columns are ignored."""
    prints = cut_lineage(fingerprints(docs, shingle))
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(points.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    named = cut_lineage(points.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def firsts_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the component_id of found; see keep_one.

    Only ids that go or repeat, and the few that a bit filter takes for these, meet their rows: a row of an id that
    is alone and the first of its component stays where it is, whole."""
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first"))
    ids = cut_lineage(ids)
    rows, back = packed(docs)
    near = F.col("doc_id").isNotNull() & may_hold(ids.where("n > 1 or not first").select("doc_id"), F.col("doc_id").cast("long"))
    named = rows.where(near).join(ids.where("first").select("doc_id"), "doc_id", "left_semi")
    least = named.groupBy("doc_id").agg(F.min_by(F.struct("text", "rest"), F.struct("text", F.to_json("rest"))).alias("row"))
    return back(least.select("doc_id", "row.text", "row.rest").unionByName(rows.where(~near)))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The row of docs with the smallest doc_id of each component, with all its columns, whatever their names.

    Of rows that repeat that doc_id the one with the least text stays, null before all, and of equal texts
    the one whose other columns are least as JSON. Rows with a null doc_id can't be told from each
    other and stay."""
    return firsts_of(docs, simhash_components(docs, shingle, max_bits))
