"""Slices, regimes and walk-forward windows against plain restatements."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from quantloom.operators import experiments, models

D = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def market(spark):
    draw = np.random.default_rng(8)
    days, names = 60, ["a", "b"]
    close = 20 * np.exp(np.cumsum(draw.normal(0, 0.02, (days, 2)), 0))
    r = np.vstack([np.zeros((1, 2)), close[1:] / close[:-1] - 1])
    r5 = np.vstack([np.zeros((5, 2)), close[5:] / close[:-5] - 1])
    rows = [(D(t), n, float(close[t, i]), float(r[t, i]), float(r5[t, i])) for t in range(days) for i, n in enumerate(names)]
    panel = spark.createDataFrame(rows, "date date, ticker string, close double, return_1d double, return_5d double").repartition(3).cache()
    return r, panel, spark.createDataFrame([(d, n, x) for d, n, _, x, _ in rows], "date date, ticker string, r double").cache()


def equal_weight(r, days, cost):
    """Values of equal weights over these days: one turnover of 2 at the start, its cash leg included, and none after it."""
    value, out = 100_000.0, []
    for k, t in enumerate(days):
        value *= 1 + r[t].mean() - (2.0 if k == 0 else 0.0) * cost
        out.append(value)
    return out


def figures(values):
    x = np.array(values)
    steps = np.concatenate(([0.0], x[1:] / x[:-1] - 1))
    total = x[-1] / x[0] - 1
    annual = (1 + total) ** (252 / len(x)) - 1
    return total, steps.std() * np.sqrt(252), annual / (steps.std() * np.sqrt(252)), (x / np.maximum.accumulate(x) - 1).min()


def close(row, values):
    total, volatility, sharpe, worst = figures(values)
    assert row.cumulative_return == pytest.approx(total) and row.volatility == pytest.approx(volatility) and row.sharpe == pytest.approx(sharpe) and row.max_drawdown == pytest.approx(worst) and row.final_value == pytest.approx(values[-1])


def test_regimes(market):
    r, panel, returns = market
    got = experiments.regime_suite(panel, returns, {"one": ("2024-01-11", "2024-01-31"), "two": ("2024-02-05", "2024-02-20"), "short": ("2024-02-21", "2024-02-25")}, lookback=4, cost=0.002, slippage=0.001).collect()
    by = {(x.regime, x.baseline): x for x in got}
    assert {k for k, _ in by} == {"one", "two"} and {b for _, b in by} == {"equal_weight", "random", "momentum", "ma_crossover", "mean_variance", "buy_hold_a", "buy_hold_b"}
    close(by["one", "equal_weight"], equal_weight(r, range(10, 31), 0.003))
    close(by["two", "equal_weight"], equal_weight(r, range(35, 51), 0.003))
    close(by["two", "buy_hold_b"], equal_weight(r[:, 1:], range(35, 51), 0.003))


def test_walk_forward(market):
    r, panel, returns = market
    got = experiments.walk_forward_run(panel, returns, train=20, validation=8, test=10, step=10, cost=0.001, slippage=0.0).collect()
    by = {(x.window, x.split, x.baseline): x for x in got}
    windows = sorted({k[0] for k in by})
    assert len(windows) == 3 and len(got) == 3 * 2 * 7
    for n, w in enumerate(windows):
        at = 10 * n + 20
        close(by[w, "validation", "equal_weight"], equal_weight(r, range(at, at + 8), 0.001))
        close(by[w, "test", "buy_hold_a"], equal_weight(r[:, :1], range(at + 8, at + 18), 0.001))


def test_random_slices(market):
    _, panel, _ = market
    take = lambda seed, df=panel: models.random_slices(df, length=12, count=6, seed=seed).toPandas()
    a = take(1)
    starts = []
    for _, part in a.groupby("slice"):
        days = sorted(set(part.date))
        assert len(days) == 12 and days == [days[0] + dt.timedelta(days=k) for k in range(12)] and len(part) == 24
        starts.append(days[0])
    assert len(set(starts)) == 6 and starts == sorted(starts)
    key = lambda x: sorted(map(tuple, x.itertuples(index=False)))
    assert key(take(1, panel.repartition(7))) == key(a) and key(take(2)) != key(a)
    assert models.random_slices(panel, length=60, count=6, seed=1).select("slice").distinct().count() == 1
