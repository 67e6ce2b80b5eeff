"""The registered queries and their SQL, gathered from the modules of plans."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent.parent
    name = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="ship-")) / "quantloom_code"), "zip", root, "quantloom")
    sc.addPyFile(name)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def _modules() -> list:
    from quantloom import plans

    return plans.modules()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _modules() for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, (_, sql) in m.QUERIES.items() if sql}
