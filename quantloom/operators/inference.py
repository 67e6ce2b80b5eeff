"""Inference by resampling (see resampling): intervals, paired differences, sign flips, and the tables made of them."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resampling import drawn, finite, name_of, series_of, stationary_index, stream

YEAR = 252


def _sharpe(x: np.ndarray) -> float:
    s = x.std(ddof=1)
    return float(x.mean() / s * np.sqrt(YEAR)) if s > 0 else 0.0


def sharpe_of(c: str) -> Column:
    """Mean over sample deviation by year; 0 without deviation."""
    return F.coalesce(F.try_divide(F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0))) * F.sqrt(F.lit(YEAR)), F.lit(0.0))


def _ends(level: float) -> list[Column]:
    """The interval of the draws' statistics, interpolated."""
    q = F.percentile("statistic", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return [q[0].alias("low"), q[1].alias("high")]


def bootstrap_sharpe(returns: DataFrame, by: str, at: str, value: str, resamples: int = 500, mean_block: float = 10.0, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Sharpe ratio of each series with a stationary-bootstrap interval; all 0 with fewer than two finite values."""
    series = series_of(returns, [by], [at], [value]).where(F.size(value) >= 2)
    draws = drawn(series, [by], [value], lambda a, g: _sharpe(a[0][stationary_index(len(a[0]), mean_block, g)]), resamples, seed)
    figures = returns.withColumn("__x", F.when(finite(value), F.col(value))).groupBy(by).agg(sharpe_of("__x").alias("sharpe"))
    return figures.join(draws.groupBy(by).agg(*_ends(level)), by, "left").select(by, "sharpe", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("low", "high")))


def bootstrap_difference(pairs: DataFrame, by: str, at: str, a: str, b: str, resamples: int = 500, mean_block: float = 10.0, seed: int = 0) -> DataFrame:
    """Difference of Sharpe ratios of paired series with an interval, and p: the share of draws in which a is not better.

    Rows count where both are finite; with fewer than three of them all figures are null."""
    both = pairs.where(finite(a) & finite(b))
    series = series_of(both, [by], [at], [a, b]).where(F.size(a) >= 3)

    def difference(x, g):
        i = stationary_index(len(x[0]), mean_block, g)
        return _sharpe(x[0][i]) - _sharpe(x[1][i])

    draws = drawn(series, [by], [a, b], difference, resamples, seed).groupBy(by).agg(*_ends(0.95), F.avg((F.col("statistic") <= 0).cast("double")).alias("p"))
    seen = both.groupBy(by).agg(F.count("*").alias("__n"), (sharpe_of(a) - sharpe_of(b)).alias("__d"))
    return pairs.select(by).distinct().join(seen, by, "left").join(draws, by, "left").select(by, F.when(F.col("__n") >= 3, F.col("__d")).alias("difference"), "low", "high", "p")


def _flips(rows: DataFrame, keys: list[str], value: str, order: list[str], draws: int, seed: int) -> DataFrame:
    """keys, mean and p: (k + 1) / (n + 1), k the sign flips whose mean is as far from zero; null without finite values."""
    series = series_of(rows, keys, order, [value])

    def extreme(x, g):
        signs = g.integers(0, 2, len(x[0])) * 2 - 1
        return abs((signs * x[0]).mean()) >= abs(x[0].mean()) - 1e-15

    found = drawn(series, keys, [value], extreme, draws, seed).groupBy(*keys).agg(((F.sum("statistic") + 1) / (draws + 1)).alias("p"))
    means = rows.withColumn("__x", F.when(finite(value), F.col(value))).groupBy(*keys).agg(F.avg("__x").alias("mean"))
    return _joined(means, found, keys)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys that may be null, without the keys of the right side."""
    r = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(r, on, "left").drop(*(f"__{k}" for k in keys))


def sign_flip(excess: DataFrame, by: str, value: str, draws: int = 2_000, seed: int = 0, order: list[str] | None = None) -> DataFrame:
    """Two-sided randomisation p of a zero mean: (k + 1) / (n + 1)."""
    return _flips(excess, [by], value, order or [value], draws, seed)


def _intervals(rows: DataFrame, keys: list[str], value: str, cluster: str | None, resamples: int, seed: int, level: float = 0.95) -> DataFrame:
    """keys, low and high: a bootstrap interval of the mean, drawing values or whole clusters of them."""
    clean = rows.where(finite(value)).withColumn("__n", F.lit(1.0))
    if cluster:
        clean = clean.groupBy(*keys, cluster).agg(F.sum(value).alias(value), F.sum("__n").alias("__n"))
    series = series_of(clean, keys, [cluster] if cluster else [value], [value, "__n"])

    def mean(x, g):
        i = g.integers(0, len(x[0]), len(x[0]))
        return x[0][i].sum() / x[1][i].sum()

    return drawn(series, keys, [value, "__n"], mean, resamples, seed).groupBy(*keys).agg(*_ends(level))


def bootstrap_mean(rows: DataFrame, by: str, value: str, cluster: str | None = None, resamples: int = 1_000, seed: int = 0) -> DataFrame:
    """Mean with a 95 % interval, drawing rows or whole clusters; null without finite values."""
    means = rows.withColumn("__x", F.when(finite(value), F.col(value))).groupBy(by).agg(F.avg("__x").alias("mean"))
    return _joined(means, _intervals(rows, [by], value, cluster, resamples, seed), [by])


def expected_best_z(trials: int) -> float:
    """Expected greatest of so many standard normal draws (the usual two-quantile approximation)."""
    n, gamma = NormalDist(), 0.5772156649015329
    return 0.0 if trials < 2 else (1 - gamma) * n.inv_cdf(1 - 1 / trials) + gamma * n.inv_cdf(1 - 1 / (trials * np.e))


def probability_over(moments: DataFrame, bar: Column | float) -> Column:
    """The probability that the true ratio exceeds bar, from moments as of metrics.probabilistic_z; 0 for a series without
    deviation and where the estimate's variance is not over 0."""
    from ..functions.scalars import normal_cdf

    sr = F.col("sharpe")
    spread = 1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr
    z = F.when(sr.isNotNull() & (spread > 0), (sr - bar) * F.sqrt(F.col("n") - 1) / F.sqrt(spread))
    return F.coalesce(normal_cdf()(z), F.lit(0.0))


def deflated(moments: DataFrame, trials: int, spread: float | None = None, by: str = "policy") -> DataFrame:
    """p of the Sharpe ratio over the expected best of so many trials; moments as of probabilistic_z. Without the
    spread of the trials' ratios that of one estimate is taken, 1 / sqrt(n - 1)."""
    one = F.when(F.col("n") > 1, 1 / F.sqrt(F.col("n") - 1)).otherwise(0.0)
    bar = F.lit(expected_best_z(trials)) * (one if spread is None else F.lit(spread))
    return moments.select(by, probability_over(moments, 0.0).alias("probabilistic"), probability_over(moments, bar).alias("deflated"))


def bootstrap_rows(returns: DataFrame, by: str, at: str, value: str, mean_block: float, seed: int, draw: int = 0) -> DataFrame:
    """One stationary bootstrap sample of each series: place, the row drawn for it and its value."""
    series = series_of(returns, [by], [at], [value]).withColumn("__name", name_of([by]))

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                x = np.asarray(row[value], float)
                i = stationary_index(len(x), mean_block, stream(seed, row["__name"], draw))
                yield pd.DataFrame({by: [row[by]] * len(i), "place": np.arange(len(i)), "drawn": i, "value": x[i]})

    return series.mapInPandas(run, f"{by} {dict(returns.dtypes)[by]}, place long, drawn long, value double")


def group_figures(rows: DataFrame, keys: list[str], value: str, counts: dict[str, str] | None = None) -> DataFrame:
    """runs (all rows), distinct counts by name, and mean, median and sample deviation (0 for one value) of the finite values.

    Sums run over the sorted values, so figures do not depend on where rows lie."""
    named = [F.count_distinct(c).alias(n) for n, c in (counts or {}).items()]
    x, n = F.col(value), F.size(value)
    total = lambda f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
    sums = series_of(rows, keys, [value], [value]).withColumn("mean", total(lambda v: v) / n)
    std = F.when(n > 1, F.sqrt(total(lambda v: (v - F.col("mean")) * (v - F.col("mean"))) / (n - 1))).otherwise(0.0)
    figures = sums.select(*keys, "mean", ((F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2).alias("median"), std.alias("std"))
    return _joined(rows.groupBy(*keys).agg(F.count("*").alias("runs"), *named), figures, keys).withColumn("std", F.coalesce("std", F.lit(0.0)))


def group_summary(rows: DataFrame, keys: list[str], value: str, cluster: str | None = None, resamples: int = 1_000, seed: int = 0, counts: dict[str, str] | None = None) -> DataFrame:
    """group_figures with a 95 % interval of the mean; counts names columns whose distinct values are counted (seeds, windows)."""
    return _joined(group_figures(rows, keys, value, counts), _intervals(rows, keys, value, cluster, resamples, seed), keys)


def positive_rate(value: str) -> Column:
    """The share of rows with a value over 0; nulls and NaN count as not positive."""
    return F.avg(F.coalesce((F.col(value) > 0) & ~F.isnan(value), F.lit(False)).cast("double"))


def paired_summary(pairs: DataFrame, keys: list[str], value: str, order: list[str], draws: int = 2_000, seed: int = 0, cluster: str | None = None, counts: dict[str, str] | None = None) -> DataFrame:
    """group_summary of an excess, with its share of wins, its sign-flip p and Holm's adjustment over all groups."""
    from .metrics import holm

    wins = pairs.groupBy(*keys).agg(positive_rate(value).alias("positive_rate"))
    tests = holm(_flips(pairs, keys, value, order, draws, seed).drop("mean"), "p", order=keys)
    return _joined(_joined(group_summary(pairs, keys, value, cluster, seed=seed, counts=counts), wins, keys), tests, keys)


def significance_table(curves: DataFrame, reference: str | None = None, trials: int = 1, resamples: int = 500, mean_block: float = 20.0, by: str = "policy", at: str = "date", value: str = "value") -> DataFrame:
    """Sharpe ratio with its interval, probabilistic and deflated Sharpe ratio of each curve, and its difference to a
    reference with interval and p. The spread of trials is unknown: that of one estimate, 1 / (n - 1), is taken."""
    from pyspark.sql import Window

    from .metrics import probabilistic_z

    r = curves.withColumn("r", F.try_divide(F.col(value), F.lag(value).over(Window.partitionBy(by).orderBy(at))) - 1).where("r is not null")
    out = bootstrap_sharpe(r, by, at, "r", resamples, mean_block).join(deflated(probabilistic_z(curves, by=by, at=at, value=value), trials, None, by), by)
    if reference is None:
        return out
    base = r.where(F.col(by) == reference).select(at, F.col("r").alias("b"))
    other = bootstrap_difference(r.where(F.col(by) != reference).join(base, at), by, at, "r", "b", resamples, mean_block)
    return out.join(other.select(by, "difference", F.col("low").alias("difference_low"), F.col("high").alias("difference_high"), "p"), by, "left")
