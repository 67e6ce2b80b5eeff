"""Canonical JSON and digests against Python's own."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import random
import struct

from pyspark.sql import functions as F

from quantloom.functions import digests


def doubles():
    draw = random.Random(1)
    some = [0.0, -0.0, 1.0, -1.5, 0.1, 1e16, 9999999999999998.0, 1e15, 123456789012345680.0, 1e-4, 1e-5, 9.999e-5, 2e-323, 5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, 2.0**-44, 8.41e21, 2e23, 1e23, 9e22, 1e22, 0.3, 2 / 3, 100.0, 1e100, 4.35, 2.0e-3, 1.1e-5, 2.5e-7]
    some += [struct.unpack("<d", struct.pack("<Q", draw.getrandbits(64)))[0] for _ in range(4000)]
    some += [draw.uniform(-1, 1) * 10 ** draw.randrange(-12, 18) for _ in range(4000)] + [round(draw.uniform(0, 1e6), draw.randrange(8)) for _ in range(3000)] + [draw.randrange(1 << 60) / 8 for _ in range(500)]
    return [x for x in some if math.isfinite(x)]


def test_shortest_floats(spark):
    x = doubles()
    got = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").select("k", digests.shortest(F.col("x")).alias("t")).collect()
    wrong = [(repr(x[r.k]), r.t) for r in got if r.t != repr(x[r.k])]
    assert not wrong, wrong[:10]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(digests.shortest(F.col("x")).alias("t")).collect()
    assert [r.t for r in odd] == [None] * 3


def test_digests_equal_those_of_json(spark):
    rows = [
        (1, True, 0.1, 'plain', dt.date(2024, 2, 29), None), (2, False, 1e-7, 'quote " back \\ slash / line \n tab \t', None, "é"), (-3, None, 1e22, "naïve 日本 😀 \x01\x7f\x1f \b\f\r", dt.date(1999, 12, 31), ""),
        (None, True, None, None, None, "퟿\U0010ffff"), (5, True, -0.0, "", None, "' '"),
    ]
    df = spark.createDataFrame(rows, "b long, a boolean, x double, t string, d date, `é k` string")
    got = df.select(digests.canonical_json(df, df.columns).alias("j"), digests.row_digest(df, df.columns).alias("h")).collect()
    for row, r in zip(rows, got, strict=True):
        text = json.dumps({c: v.isoformat() if isinstance(v, dt.date) else v for c, v in zip(df.columns, row, strict=True)}, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)
        assert r.j == text and r.h == hashlib.sha256(text.encode()).hexdigest()
    bad = spark.createDataFrame([(float("nan"),)], "x double")
    assert bad.select(digests.row_digest(bad, ["x"])).first()[0] is None
