"""Regression by folds, principal components of wide vectors and permuted groups against NumPy and plain loops."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import models, resampling

D = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)


def fitted(x, y, alpha):
    """Weights and constant of a ridge regression on standardised features."""
    scale = x.std(0)
    scale[scale == 0] = 1
    z = (x - x.mean(0)) / scale
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / scale
    return b, y.mean() - x.mean(0) @ b


def test_refits_of_two_hundred_features(spark):
    draw = np.random.default_rng(1)
    days, wide = 550, 200
    x = draw.normal(size=(days * 2, wide)) + draw.normal(size=wide) * 3
    x[:, 7] = 4.0
    y = x[:, :5].sum(1) + draw.normal(size=days * 2)
    names = [f"f{i}" for i in range(wide)]
    rows = [(D(k // 2), f"t{k % 2}", *map(float, v), None if k % 13 == 0 else float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "date date, ticker string, " + ", ".join(f"{n} double" for n in names) + ", y double").repartition(5)
    untils = [D(150 + 40 * k).isoformat() for k in range(10)]
    got = {(r.date, r.ticker): (r.fold, r.forecast) for r in models.ridge_folds(df, names, "y", 2.0, untils).collect()}
    dates, has = np.array([r[0] for r in rows]), np.array([r[-1] is not None for r in rows])
    ends = [*(dt.date.fromisoformat(u) for u in untils), dt.date(2100, 1, 1)]
    assert len(got) == (dates > ends[0]).sum()
    for fold, end in enumerate(ends[:-1]):
        fit = (dates <= end) & has
        b, c = fitted(x[fit], y[fit], 2.0)
        for k in np.flatnonzero((dates > end) & (dates <= ends[fold + 1])):
            f, v = got[rows[k][0], rows[k][1]]
            assert f == fold and v == pytest.approx(x[k] @ b + c, rel=1e-7, abs=1e-7)
    with pytest.raises(ValueError, match="ascend"):
        models.ridge_folds(df, names[:2], "y", 1.0, untils[::-1])
    one = {(r.date, r.ticker): r.forecast for r in models.ridge(df, names, "y", 2.0, untils[0]).collect()}
    assert len(one) == len(rows) and one[rows[-1][0], rows[-1][1]] == pytest.approx(x[-1] @ fitted(x[(dates <= ends[0]) & has], y[(dates <= ends[0]) & has], 2.0)[0] + fitted(x[(dates <= ends[0]) & has], y[(dates <= ends[0]) & has], 2.0)[1], abs=1e-7)


@pytest.mark.parametrize(("dims", "whole"), [(24, None), (24, False), (1024, None)])
def test_components_of_wide_vectors(spark, dims, whole):
    draw = np.random.default_rng(dims)
    basis = np.linalg.qr(draw.normal(size=(dims, 12)))[0]
    x = draw.normal(size=(300, 12)) * (3.0 ** -np.arange(12)) @ basis.T * 50 + draw.normal(size=(300, dims)) * 1e-3 + 2.0
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (999, None)], "i long, v array<double>").repartition(4)
    got = {r.i: np.array([r.pc_1, r.pc_2, r.pc_3]) if r.pc_1 is not None else None for r in models.pca_scores(df, "i", "v", 3, F.col("i") < 250, whole=whole).collect()}
    fit = x[:250]
    vectors = np.linalg.svd(fit - fit.mean(0), full_matrices=False)[2][:3].T
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(3)])
    assert got[999] is None and len(got) == 301
    assert max(np.abs(got[i] - (v - fit.mean(0)) @ vectors).max() for i, v in enumerate(x)) < 1e-6 * np.abs(x).max()


def test_lengths_are_checked(spark):
    for bad in ([(1, [1.0, 2.0]), (2, [1.0])], [(1, [1.0, None]), (2, [1.0, 2.0])], [(1, [1.0])]):
        with pytest.raises(ValueError, match="components"):
            models.pca_scores(spark.createDataFrame(bad, "i long, v array<double>"), "i", "v", 2, F.lit(True))
    assert models.pca_scores(spark.createDataFrame([(1, None)], "i long, v array<double>"), "i", "v", 2, F.lit(True)).collect()[0][1:] == (None, None)


def test_groups_under_permutation(spark):
    draw = np.random.default_rng(3)
    days, tickers, names = 30, ["a", "b", "c", "d"], ["x", "y", "z"]
    x, r = draw.normal(size=(days, 4, 3)), draw.normal(0, 0.01, size=(days, 4))
    gone = {(5, 1), (17, 3)}
    rows = [(D(t), n, *map(float, x[t, i]), float(r[t, i])) for t in range(days) for i, n in enumerate(tickers) if (t, i) not in gone]
    df = spark.createDataFrame(rows, "date date, ticker string, x double, y double, z double, r double").repartition(3)
    groups = {"W": ["x", "y"], "N": ["z"], "none": []}

    def policy(m):
        s = np.maximum(m[:, 0] - 0.5 * m[:, 1] + m[:, 2], 0)
        return s / s.sum() if s.sum() > 0 else np.zeros(len(m))

    got = {(g.group, g.repeat): g for g in models.group_attribution(df, groups, policy, "r", 3, 9).collect()}
    assert set(got) == {(g, k) for g in groups for k in range(3)}
    held = [[i for i in range(4) if (t, i) not in gone] for t in range(days)]
    ahead = lambda t, i: next((r[u, i] for u in range(t + 1, days) if (u, i) not in gone), 0.0)
    for (g, k), row in got.items():
        order = resampling.stream(9, g, k).permutation(days)
        columns, values, shift = [names.index(c) for c in groups[g]], {"a": [1.0], "b": [1.0]}, []
        for t in range(days):
            m = x[t, held[t]]
            mixed = m.copy()
            for j, i in enumerate(held[t]):
                if i in held[order[t]]:
                    mixed[j, columns] = x[order[t], i, columns]
            a, b = policy(m), policy(mixed)
            nxt = np.array([ahead(t, i) for i in held[t]])
            values["a"].append(values["a"][-1] * (1 + a @ nxt))
            values["b"].append(values["b"][-1] * (1 + b @ nxt))
            shift.append(np.abs(a - b).sum() / 2)
        total = {n: v[-1] / v[1] - 1 for n, v in values.items()}
        assert row.features == len(groups[g]) and row.action_shift == pytest.approx(np.mean(shift), abs=1e-12) and row.base_cumulative_return == pytest.approx(total["a"])
        assert row.delta_cumulative_return == pytest.approx(total["b"] - total["a"], abs=1e-12) and (g != "none" or row.delta_sharpe == 0)
