"""Blocks of time inside a key: what must run in order over one key is dealt out to many tasks.

Keys with many rows are cut at approximate quantiles of their own times; rows of equal time stay together. A block is
of bounded size, so windows and folds inside (key, block) fit a task, and what a block hands on to the next is one row: at most
BLOCKS_A_TASK blocks for each shuffle partition, and one more for each cut key, whatever the table. The cuts are read
once by the driver, as they must not change when a task is run again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DoubleType, IntegralType, LongType, NumericType, StructField, StructType, TimestampNTZType, TimestampType

#: Rows of a block at least, and blocks for each shuffle partition at most, about.
LEAST_ROWS, BLOCKS_A_TASK = 100_000, 16
#: Inputs of fewer bytes are not counted: one task sorts them as fast as they can be counted. Results are the same.
SMALL_INPUT = 32 << 20


def small_input(df: DataFrame) -> bool:
    """Whether the tables that df reads are known to be small."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) < SMALL_INPUT


def number_of(df: DataFrame, at: str) -> Column | None:
    """A time as a number in the same order; None for types that have none."""
    kind = df.schema[at].dataType
    if isinstance(kind, DateType):
        return F.unix_date(at).cast("long")
    if isinstance(kind, TimestampType):
        return F.unix_micros(at)
    if isinstance(kind, TimestampNTZType):
        return F.unix_micros(F.col(at).cast("timestamp"))
    if isinstance(kind, IntegralType):
        return F.col(at).cast("long")
    return F.col(at).cast("double") if isinstance(kind, NumericType) else None


def block_of(x: Column, cuts: Column, most: int) -> Column:
    """The number of ascending cuts below x, by halving: a few steps, however many cuts there are."""
    powers = F.array(*(F.lit(1 << k) for k in range(max(most, 1).bit_length() - 1, -1, -1)))
    return F.aggregate(powers, F.lit(0), lambda lo, p: F.when(F.get(cuts, lo + p - 1) < x, lo + p).otherwise(lo))


@dataclass(frozen=True)
class Cuts:
    """The cuts of the frequent keys: rows of by and __cuts, and the number of cuts of the most frequent one."""

    by: list[str]
    at: str
    rows: DataFrame
    most: int

    def with_block(self, df: DataFrame) -> DataFrame:
        """df with __b, the block of a row inside its key, and __cut, whether its key has been cut."""
        x = number_of(df, self.at)
        named = self.rows.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(self.by)), "__cuts")
        on = F.lit(True)
        for i, c in enumerate(self.by):
            on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
        met = df.withColumn("__x", x).join(F.broadcast(named), on, "left")
        return met.withColumns({"__b": F.coalesce(block_of(F.col("__x"), F.col("__cuts"), self.most), F.lit(0)), "__cut": F.col("__cuts").isNotNull()}).drop("__x", "__cuts", *(f"__k{i}" for i in range(len(self.by))))

    def blocks(self) -> DataFrame:
        """A row for each block: by and __b."""
        return self.rows.select(*self.by, F.explode(F.sequence(F.lit(0), F.size("__cuts"))).alias("__b"))


def cuts_of(df: DataFrame, by: list[str], at: str, least_rows: int = LEAST_ROWS) -> Cuts | None:
    """The cuts of the keys that fill more than two blocks; None where there are none, at has no number, or the input is
    small and least_rows the usual."""
    spark, x = df.sparkSession, number_of(df, at)
    if x is None or least_rows == LEAST_ROWS and small_input(df):
        return None
    rows = df.select(*by, x.alias("__x")).where("__x is not null")
    counts = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("rows"), F.max("__n").alias("most")).first()
    size = max(least_rows, (total.rows or 0) // (BLOCKS_A_TASK * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    if (total.most or 0) <= 2 * size:
        return None
    grid = -(-total.most // size)
    frequent = counts.where(F.col("__n") > 2 * size).select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    shares = [(k + 1) / grid for k in range(grid - 1)]
    fine = rows.join(F.broadcast(frequent), on, "left_semi").groupBy(*by).agg(F.count("*").alias("__n"), F.percentile_approx("__x", shares, max(10_000, 20 * grid)).alias("__q"))
    # a key takes as many of the finest cuts as its own blocks need
    wanted = F.greatest(F.ceil(F.col("__n") / size).cast("int") - 1, F.lit(1))
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), wanted), lambda k: F.element_at("__q", F.least(F.greatest(F.round(k * grid / (wanted + 1)).cast("int"), F.lit(1)), F.lit(grid - 1)))))
    found = fine.select(*by, cuts.alias("__cuts")).collect()
    kind = LongType() if dict(rows.dtypes)["__x"] == "bigint" else DoubleType()
    schema = StructType([*(df.schema[c] for c in by), StructField("__cuts", ArrayType(kind))])
    return Cuts(by, at, spark.createDataFrame([tuple(r) for r in found], schema), max(len(r["__cuts"]) for r in found))
