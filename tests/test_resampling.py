"""Resampling against plain loops on the same drawn numbers, and the rules for flat, zero and missing values."""

from __future__ import annotations

import datetime as dt
import json
import math
import statistics

import numpy as np
import pytest

from quantloom.operators import inference, metrics, portfolio, resampling

D = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
NORMAL = statistics.NormalDist()


def name(**keys):
    return json.dumps(keys, separators=(",", ":"))


def walk(n, mean_block, g):
    """Indices drawn one by one: with a chance of 1 / mean_block a fresh start, else the next row."""
    u, starts, out = g.random(n), None, []
    starts = g.integers(0, n, n)
    for k in range(n):
        out.append(int(starts[k]) if k == 0 or u[k] < 1 / mean_block else (out[-1] + 1) % n)
    return out


def sharpe(x):
    s = statistics.stdev(x)
    return statistics.fmean(x) / s * math.sqrt(252) if s > 0 else 0.0


def quantile(x, q):
    x = sorted(x)
    at = q * (len(x) - 1)
    low = math.floor(at)
    return x[low] + (x[min(low + 1, len(x) - 1)] - x[low]) * (at - low)


@pytest.fixture(scope="module")
def returns(spark):
    draw = np.random.default_rng(4)
    rows = [(p, D(k), float(draw.normal(0.001 * (p == "up"), 0.01)), float(draw.normal(0, 0.01))) for p in ("up", "down") for k in range(50)]
    rows += [("flat", D(k), 0.0, 0.001 * k) for k in range(9)] + [("two", D(0), 0.1, 0.2), ("two", D(1), 0.2, 0.1), ("none", D(0), None, 1.0), ("nan", D(0), float("nan"), 1.0), ("up", D(99), None, 0.5)]
    return rows, spark.createDataFrame(rows, "policy string, date date, r double, b double").repartition(4)


def test_indices_follow_the_definition():
    for n, mean in ((1, 5.0), (7, 2.0), (40, 10.0)):
        for k in range(20):
            assert resampling.stationary_index(n, mean, resampling.stream(3, "s", k)).tolist() == walk(n, mean, resampling.stream(3, "s", k))
    # hand-made draws: starts of blocks at places 0, 2 and 3
    class Draw:
        def random(self, n):
            return np.array([0.9, 0.9, 0.1, 0.2, 0.9])

        def integers(self, low, high, n):
            return np.array([3, 0, 4, 1, 2])

    assert resampling.stationary_index(5, 4.0, Draw()).tolist() == [3, 4, 4, 1, 2]


def test_bootstrap_rows(spark, returns):
    rows, df = returns
    got = inference.bootstrap_rows(df, "policy", "date", "r", 6.0, 11, draw=2)
    for p in ("up", "down", "two"):
        x = [r[2] for r in rows if r[0] == p and r[2] is not None]
        found = got.where(f"policy = '{p}'").orderBy("place").collect()
        assert [r.drawn for r in found] == walk(len(x), 6.0, resampling.stream(11, name(policy=p), 2)) and [r.value for r in found] == [x[r.drawn] for r in found]


def test_bootstrap_sharpe(spark, returns):
    rows, df = returns
    got = {r.policy: r for r in inference.bootstrap_sharpe(df, "policy", "date", "r", resamples=700, mean_block=8.0, seed=5).collect()}
    for p in ("up", "down", "flat", "two"):
        x = [r[2] for r in rows if r[0] == p and r[2] is not None]
        found = [sharpe([x[i] for i in walk(len(x), 8.0, resampling.stream(5, name(policy=p), k))]) for k in range(700)]
        assert got[p].sharpe == pytest.approx(sharpe(x)) and got[p].low == pytest.approx(quantile(found, 0.025)) and got[p].high == pytest.approx(quantile(found, 0.975))
    assert [tuple(got[p])[1:] for p in ("none", "nan")] == [(0.0, 0.0, 0.0)] * 2


def test_bootstrap_difference(spark, returns):
    rows, df = returns
    got = {r.policy: r for r in inference.bootstrap_difference(df, "policy", "date", "r", "b", resamples=300, mean_block=5.0, seed=7).collect()}
    for p in ("up", "down", "flat"):
        both = [(r[2], r[3]) for r in rows if r[0] == p and r[2] is not None]
        a, b = zip(*both, strict=True)
        found = []
        for k in range(300):
            i = walk(len(a), 5.0, resampling.stream(7, name(policy=p), k))
            found.append(sharpe([a[j] for j in i]) - sharpe([b[j] for j in i]))
        assert got[p].difference == pytest.approx(sharpe(a) - sharpe(b)) and got[p].low == pytest.approx(quantile(found, 0.025))
        assert got[p].p == pytest.approx(sum(f <= 0 for f in found) / 300)  # k of n, without the one added for sign flips
    assert [tuple(got[p])[1:] for p in ("two", "none", "nan")] == [(None,) * 4] * 3


def test_sign_flips(spark, returns):
    rows, df = returns
    got = {r.policy: r for r in inference.sign_flip(df, "policy", "r", draws=600, seed=2, order=["date"]).collect()}
    for p in ("up", "down", "two"):
        x = [r[2] for r in rows if r[0] == p and r[2] is not None]
        extreme = 0
        for k in range(600):
            signs = resampling.stream(2, name(policy=p), k).integers(0, 2, len(x))
            extreme += abs(sum(v if s else -v for v, s in zip(x, signs, strict=True)) / len(x)) >= abs(sum(x) / len(x)) - 1e-15
        assert got[p].p == pytest.approx((extreme + 1) / 601) and got[p].mean == pytest.approx(sum(x) / len(x))
    assert got["none"].p is None and got["nan"].mean is None and got["flat"].p == 1.0


@pytest.mark.parametrize("cluster", [None, "month"])
def test_bootstrap_mean(spark, returns, cluster):
    rows, df = returns
    df = df.selectExpr("*", "cast(datediff(date, '2024-01-01') / 7 as int) as month")
    got = {r.policy: r for r in inference.bootstrap_mean(df, "policy", "r", cluster, resamples=250, seed=9).collect()}
    for p in ("up", "two", "flat"):
        own = [((r[1] - D(0)).days // 7, r[2]) for r in rows if r[0] == p and r[2] is not None]
        groups = [[x] for x in sorted(x for _, x in own)] if cluster is None else [[x for m, x in own if m == k] for k in sorted({m for m, _ in own})]
        found = []
        for k in range(250):
            taken = [groups[i] for i in resampling.stream(9, name(policy=p), k).integers(0, len(groups), len(groups))]
            found.append(sum(map(sum, taken)) / sum(map(len, taken)))
        mean = sum(x for _, x in own) / len(own)
        assert got[p].mean == pytest.approx(mean) and got[p].low == pytest.approx(quantile(found, 0.025), abs=1e-12) and got[p].high == pytest.approx(quantile(found, 0.975), abs=1e-12)
    assert tuple(got["nan"])[1:] == (None, None, None)


def test_draws_do_not_change_with_their_number_and_spread(spark):
    """Many draws of one series are made by all tasks, and the first of them are those of a shorter run."""
    one = spark.createDataFrame([("s", [float(k) for k in range(30)])], "k string, x array<double>")
    first = lambda a, g: float(g.random())
    few = {r.draw: r.statistic for r in resampling.drawn(one, ["k"], ["x"], first, 700, 1).collect()}
    many = resampling.drawn(one, ["k"], ["x"], first, 50_000, 1)
    assert {r.draw: r.statistic for r in many.where("draw < 700").collect()} == few
    sizes = [r[0] for r in many.selectExpr("spark_partition_id() as p").groupBy("p").count().select("count").collect()]
    assert sum(sizes) == 50_000 and len(sizes) == 4 and max(sizes) <= 2 * 50_000 / 4
    other = {r.statistic for r in resampling.drawn(one, ["k"], ["x"], first, 700, 2).collect()}
    assert not other & set(few.values()) and len(set(few.values())) == 700


def test_summaries_count_what_is_missing(spark):
    rows = [("a", "s1", 1, 0.5), ("a", "s2", 1, None), ("a", "s1", 2, -0.5), ("a", "s3", 2, float("nan")), ("b", "s1", 1, None), (None, "s1", 1, 2.0)]
    df = spark.createDataFrame(rows, "policy string, seed string, window int, x double")
    got = {r.policy: r for r in inference.paired_summary(df, ["policy"], "x", ["window", "seed"], draws=50, cluster="window", counts={"seeds": "seed", "windows": "window"}).collect()}
    a, b, n = got["a"], got["b"], got[None]
    assert (a.runs, a.seeds, a.windows, a.mean, a.median) == (4, 3, 2, 0.0, 0.0) and a.std == pytest.approx(statistics.stdev([0.5, -0.5])) and a.positive_rate == 0.25
    assert (b.runs, b.mean, b.std, b.low, b.positive_rate, b.p, b.holm) == (1, None, 0.0, None, 0.0, None, None)
    assert (n.runs, n.mean, n.low, n.high, n.positive_rate) == (1, 2.0, 2.0, 2.0, 1.0) and n.p == 1.0


def curve(spark, **values):
    return spark.createDataFrame([(p, D(k), float(v)) for p, x in values.items() for k, v in enumerate(x)], "policy string, date date, value double")


def test_flat_and_zero_curves(spark):
    df = curve(spark, flat=[100] * 6, zero=[100, 0, 0, 50, 60], starts=[0, 10, 11, 12], moves=[100, 101, 99, 104, 103])
    z = {r.policy: r for r in metrics.probabilistic_z(df).collect()}
    assert (z["flat"].sharpe, z["flat"].z, z["flat"].skew, z["flat"].kurtosis) == (None, None, 0.0, 3.0)
    d = {r.policy: r for r in inference.deflated(metrics.probabilistic_z(df), trials=10).collect()}
    assert (d["flat"].probabilistic, d["flat"].deflated) == (0.0, 0.0) and d["moves"].probabilistic == pytest.approx(NORMAL.cdf(z["moves"].z)) and d["moves"].deflated < d["moves"].probabilistic
    m = {r.policy: r for r in metrics.equity_metrics(df).collect()}
    assert m["flat"].sharpe == 0 and m["zero"].cumulative_return == pytest.approx(-0.4) and m["zero"].max_drawdown == -1.0 and m["starts"].cumulative_return is None and m["starts"].sharpe == 0
    assert {r.policy: r.n for r in metrics.sharpe(df).collect()} == {"flat": 5, "zero": 2, "starts": 2, "moves": 4}
    b = {r.policy for r in metrics.benchmark_metrics(df, df.where("policy = 'moves'").drop("policy")).collect()}
    assert b == {"flat", "zero", "starts", "moves"}


def test_random_weights_leave_cash(spark):
    names = lambda n: [(D(k), f"t{j}") for k in range(40) for j in range(n)]
    two = portfolio.random_weights(spark.createDataFrame(names(2), "date date, ticker string"), 1).toPandas().groupby("date").weight.sum()
    assert two.max() <= 1 + 1e-12 and 0.1 < (two < 0.999).mean() < 0.9
    ten = portfolio.random_weights(spark.createDataFrame(names(10), "date date, ticker string"), 1).toPandas().groupby("date").weight.sum()
    assert (ten.between(1 - 1e-12, 1 + 1e-12)).mean() > 0.9
