"""Every registered query against its SQL in DuckDB, or at least run to its end."""

from __future__ import annotations

import math
import numbers

import duckdb
import pandas as pd
import pytest

from quantloom import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, numbers.Number) and not isinstance(v, bool):
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")
    return str(v)[:10] if hasattr(v, "year") else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    expected = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.toPandas()) == rows(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
