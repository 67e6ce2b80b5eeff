"""Resampling by counters: draw k of a series is the same wherever it is made, and however many draws there are.

A draw has its own stream of random numbers: a counter-based generator (Philox) keyed by the seed and the series' name, whose counter
starts at the draw's number. So draws need no order, blocks of BLOCK draws are the parallel axis, and one series with very many draws
uses every task. A task sends its draws' statistics on, one number each; counts are added up before they leave it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Draws of a block.
BLOCK = 500


def stream(seed: int, name: str, draw: int) -> np.random.Generator:
    """The random numbers of one draw of one series."""
    key = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
    return np.random.Generator(np.random.Philox(key=np.array([seed % (1 << 64), key], np.uint64), counter=np.array([0, 0, 0, draw], np.uint64)))


def stationary_index(n: int, mean_block: float, draw: np.random.Generator) -> np.ndarray:
    """Indices of one stationary bootstrap sample (Politis and Romano 1994): runs of geometric length that wrap round."""
    fresh = draw.random(n) < 1.0 / mean_block
    fresh[0] = True
    starts = draw.integers(0, n, n)
    since = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return (starts[np.maximum.accumulate(np.where(fresh, np.arange(n), 0))] + since) % n


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def series_of(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row a key with an array of each value in order; rows in which a value is not finite are left out.

    Ties in the order are broken by the values, so arrays do not depend on where rows lie."""
    clean = rows
    for v in values:
        clean = clean.where(finite(v))
    item = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate([*order, *values])), *(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)))
    lists = clean.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__s"))
    field = lambda name: F.transform("__s", lambda x: x[name])
    return lists.select(*keys, *(field(f"v{i}").alias(v) for i, v in enumerate(values)))


def name_of(keys: list[str]) -> Column:
    """The name of a series: its keys as text."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def drawn(series: DataFrame, keys: list[str], arrays: list[str], statistic: Callable[[list[np.ndarray], np.random.Generator], float], draws: int, seed: int) -> DataFrame:
    """keys, draw (from 0) and statistic of so many draws of each row of series(keys, arrays).

    statistic gets the row's arrays and the draw's own stream."""
    blocks = series.select(*keys, *arrays, name_of(keys).alias("__name"), F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // BLOCK))).alias("__block"))
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*(series.schema[k] for k in keys), StructField("draw", LongType()), StructField("statistic", DoubleType())])

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                held, first = [np.asarray(row[a], float) for a in arrays], row["__block"] * BLOCK
                numbers = range(first, min(first + BLOCK, draws))
                found = [float(statistic(held, stream(seed, row["__name"], k))) for k in numbers]
                yield pd.DataFrame({k: pd.Series([row[k]] * len(found), dtype=batch[k].dtype) for k in keys} | {"draw": list(numbers), "statistic": found})

    return blocks.repartition(tasks, "__name", "__block").mapInPandas(run, schema)
