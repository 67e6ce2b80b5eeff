"""Frequent keys in blocks: recursive means, as-of joins, and intervals by equal values, against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators import asof, blocks, windows

DAY = dt.date(2024, 1, 1)


def loop(values, span):
    """The recursive mean by its definition: weights of what came before fade at each row."""
    keep, e, w, out = 1 - 2 / (span + 1), None, 1.0, []
    for x in values:
        if e is not None:
            w *= keep
        if x is not None:
            e = x if e is None else (w * e + (1 - keep) * x) / (w + 1 - keep)
            w = 1.0
        out.append(e)
    return out


@pytest.mark.parametrize("least_rows", [blocks.LEAST_ROWS, 40, 7])
def test_recursive_means_of_a_frequent_entity(spark, least_rows):
    draw = random.Random(1)
    series = {"hot": 900, "warm": 60, "one": 1, "nulls": 30, None: 50}
    rows = []
    for name, n in series.items():
        values = [None if name == "nulls" or draw.random() < 0.2 or (name == "hot" and 200 <= k < 340) else draw.uniform(1, 9) for k in range(n)]
        rows += [(name, DAY + dt.timedelta(days=k), x, [k]) for k, x in enumerate(values)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, other array<int>").repartition(5)
    got = windows.with_ema(df, (3, 12), least_rows=least_rows)
    assert got.columns == ["ticker", "date", "close", "other", "ema_3", "ema_12"]
    found = {(r.ticker, r.date): r for r in got.collect()}
    assert len(found) == len(rows)
    for name in series:
        own = [r for r in rows if r[0] == name]
        for span in (3, 12):
            for (_, day, x, other), e in zip(own, loop([r[2] for r in own], span), strict=True):
                r = found[name, day]
                assert (r.close, r.other) == (x, other) and r[f"ema_{span}"] == (pytest.approx(e, rel=1e-12) if e is not None else None)


def test_recursive_means_are_spread(spark):
    df = spark.range(4000).select(F.lit("a").alias("ticker"), F.col("id").alias("date"), F.col("id").cast("double").alias("close"))
    cuts = blocks.cuts_of(df, ["ticker"], "date", 100)
    sizes = [r[1] for r in cuts.with_block(df).groupBy("__b").count().collect()]
    assert len(sizes) == cuts.blocks().count() >= 30 and max(sizes) <= 2 * min(sizes)
    assert "collect_list" not in windows.with_ema(df, (3,), least_rows=100)._jdf.queryExecution().toString()


def plain_asof(left, right, max_days, strict):
    out = []
    for key, day, i in left:
        ok = [(d, v) for k, d, v in right if key is not None and k == key and d is not None and day is not None and (d < day if strict else d <= day)]
        best = max(ok, default=None)
        if best and max_days is not None and (day - best[0]).days > max_days:
            best = None
        out.append((i, best and best[1], best and best[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("strict", "max_days"), [(False, None), (True, None), (False, 6), (True, 3)])
def test_asof_of_a_frequent_key(spark, strict, max_days):
    draw = random.Random(2)
    key = lambda: draw.choice(["hot"] * 6 + ["b", "c", None])
    day = lambda far: None if draw.random() < 0.03 else DAY + dt.timedelta(days=draw.randrange(far))
    left = [(key(), day(400), i) for i in range(700)]
    # rare enough that many blocks have none; ties on the same date
    right = [(key(), day(400), v) for v in range(60)] + [("hot", DAY + dt.timedelta(days=77), v) for v in range(5)]
    a, b = spark.createDataFrame(left, "k string, date date, i int").repartition(4), spark.createDataFrame(right, "k string, seen date, v int")
    for least_rows in (blocks.LEAST_ROWS, 20):
        got = asof.asof_join(a, b, ["k"], "date", "seen", ["v"], max_days, strict, least_rows)
        assert sorted(map(tuple, got.select("i", "v", "matched_at").collect()), key=str) == plain_asof(left, right, max_days, strict)


def test_half_of_all_rows_under_one_key(spark):
    """No task of the window gets over twice the mean, where the plain plan has one with half of all rows."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("k"), F.col("id").alias("t"))
    cuts = blocks.cuts_of(rows, ["k"], "t", 500)
    sizes = [r[0] for r in cuts.with_block(rows).repartition(4, "k", "__b").groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * sum(sizes) / 4
    assert {r.k for r in cuts.rows.collect()} == {"hot"}


def plain_intervals(left, intervals, by, published):
    return sorted(((i, n) for i, key, day in left for n, k, a, b, p in intervals if day is not None and a is not None and (not by or (key is not None and key == k)) and a <= day and (b is None or day < b) and (not published or (p is not None and p <= day))), key=str)


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("published", [None, "p"])
def test_intervals(spark, by, published):
    draw = random.Random(3)
    some = lambda far: None if draw.random() < 0.05 else DAY + dt.timedelta(days=draw.randrange(-far, far))
    left = [(i, draw.choice(["a", "b", None]), some(300)) for i in range(300)]
    intervals = [(n, draw.choice(["a", "b", None]), some(250), some(250), some(300)) for n in range(60)]
    intervals += [(100, "a", dt.date(1, 1, 1), dt.date(9999, 12, 31), DAY), (101, "a", DAY, DAY, DAY), (102, "b", DAY, DAY + dt.timedelta(days=1), DAY), (103, "a", DAY, None, None)]
    a = spark.createDataFrame(left, "i int, k string, date date")
    b = spark.createDataFrame(intervals, "n int, k string, since date, until date, p date")
    b = b if by else b.drop("k")
    expected = plain_intervals(left, intervals, by, published)
    inner = asof.interval_join(a, b, "date", "since", "until", by, published)
    assert sorted(map(tuple, inner.select("i", "n").collect()), key=str) == expected
    outer = asof.interval_join(a, b, "date", "since", "until", by, published, "left")
    held = {i for i, _ in expected}
    assert sorted(map(tuple, outer.select("i", "n").collect()), key=str) == sorted([*expected, *((i, None) for i, _, _ in left if i not in held)], key=str)
    assert outer.columns == inner.columns
    for plan in (inner, outer):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_interval_ranges_are_few(spark):
    """An interval of n days is at most two ranges of each length, which cover each of its days once."""
    rows = [(n, DAY, DAY + dt.timedelta(days=n)) for n in (0, 1, 2, 30, 365, 1000)]
    got = asof._indexed(spark.createDataFrame(rows, "n int, since date, until date"), "since", "until")
    first = (DAY - dt.date(1970, 1, 1)).days
    for n, _, _ in rows:
        found = [(r["__level"], r["__i"]) for r in got.where(F.col("n") == n).collect()]
        days = sorted(d for level, i in found for d in range(i << level, (i + 1) << level))
        assert days == list(range(first, first + n + 1))
        assert all(sum(level == x for level, _ in found) <= 2 for x in range(12))
    assert asof.interval_join(spark.createDataFrame([(1, DAY)], "i int, date date"), got.select("n", "since", "until").limit(0), "date", "since", "until", []).count() == 0


def test_exactly_one_match(spark):
    left = [(i, DAY + dt.timedelta(days=i)) for i in range(30)]
    intervals = [(f"r{k}", DAY + dt.timedelta(days=4 * k), DAY + dt.timedelta(days=4 * k + k)) for k in range(7)]
    got = asof.only_match(spark.createDataFrame(left, "i int, date date"), spark.createDataFrame(intervals, "r string, a date, b date"), ["i"], "date", "a", "b", [], "r")
    for i, r, n in got.collect():
        held = [name for name, a, b in intervals if a <= DAY + dt.timedelta(days=i) < b]
        assert n == len(held) and r == (held[0] if n == 1 else None)
