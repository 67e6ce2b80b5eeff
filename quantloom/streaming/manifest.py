"""A manifest of a tree of result files that grows: each run reads the files that no run before has read.

The file source of structured streaming remembers in its checkpoint which files it has taken; a run takes what is there and ends. Each
batch is summed up by source and replaces the manifest's rows of these sources in a new version, a folder named by the batch. A batch
that fails is taken again under the same number, so it writes the same version over and no row is there twice; readers see
the last version that was written whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import upsert


def versions(spark: SparkSession, manifest: str) -> list[int]:
    """The versions of a manifest that were written whole, ascending."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{manifest.rstrip('/')}/version=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def read_manifest(spark: SparkSession, manifest: str, before: int | None = None) -> DataFrame | None:
    """The last version, or the last one before a batch; None where there is none."""
    there = [v for v in versions(spark, manifest) if before is None or v < before]
    return spark.read.parquet(f"{manifest.rstrip('/')}/version={there[-1]:012d}") if there else None


def write_batch(rows: DataFrame, batch: int, manifest: str, source: Column, summary: list[Column]) -> None:
    """The manifest with the sources of rows as they are in this batch: source, batch and the summary of its rows."""
    spark = rows.sparkSession
    new = rows.groupBy(source.alias("source")).agg(*summary).withColumn("batch", F.lit(batch).cast("long"))
    old = read_manifest(spark, manifest, batch)
    full = new if old is None else upsert(old, new, "source")
    full.write.mode("overwrite").parquet(f"{manifest.rstrip('/')}/version={batch:012d}")


def scan_new(spark: SparkSession, tree: str, schema: str, manifest: str, checkpoint: str, source: Column, summary: list[Column], kind: str = "csv", glob: str = "part-*", **options: str) -> DataFrame | None:
    """Read the files below tree that are new since the last run with this checkpoint, and return the manifest.

    source names what a row belongs to, as an expression over the file's columns and source_path; summary are aggregates. Files
    of a source that has rows in the manifest already replace them."""
    rows = spark.readStream.schema(schema).format(kind).options(recursiveFileLookup="true", pathGlobFilter=glob, **options).load(tree).withColumn("source_path", F.col("_metadata.file_path"))
    query = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: write_batch(df, batch, manifest, source, summary)).start()
    query.awaitTermination()
    return read_manifest(spark, manifest)
