"""Metrics of equity curves. Windows and groups share one exchange on the policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def _stepped(curve: DataFrame, by: str, at: str, value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(at)
    peak = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = {"__r": F.try_divide(F.col(value), F.lag(value).over(w)) - 1, "__dd": F.try_divide(F.col(value), peak) - 1}
    return curve.withColumns({k: F.coalesce(c, F.lit(0.0)) for k, c in steps.items()})


def equity_metrics(curve: DataFrame, by: str = "policy", at: str = "date", value: str = "value") -> DataFrame:
    """Nineteen figures of each curve(date, value, turnover, cost, slippage, cash_weight).

    The first return counts as 0 and belongs to the number of periods; deviations are of the
    population and by the year. VaR is the interpolated 5 % quantile, CVaR the mean at or below it. A column
    that the curve lacks counts as 0. A step from a value of 0 has no return and counts as 0; a curve that
    begins with 0 has no growth, and its ratios are 0."""
    s = _stepped(curve, by, at, value)
    s = s.withColumns({c: F.lit(0.0) for c in ("turnover", "cost", "slippage", "cash_weight") if c not in s.columns})
    r = F.col("__r")
    down = F.when(r < 0, r).otherwise(0.0)
    year = F.sqrt(F.lit(YEAR))
    base = s.groupBy(by).agg(
        F.count("*").alias("n"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("final_value"), (F.stddev_pop(r) * year).alias("volatility"), (F.sqrt(F.avg(down * down)) * year).alias("downside_deviation"),
        F.min("__dd").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("win_rate"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("__gain"), F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("__loss"),
        F.percentile(r, 0.05).alias("var_95"), F.avg("turnover").alias("average_turnover"), F.sum("turnover").alias("total_turnover"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum("slippage"), F.lit(0.0)).alias("total_slippage"), F.count_if(F.col("turnover") > 1e-6).alias("active_steps"), F.coalesce(F.avg("cash_weight"), F.lit(0.0)).alias("average_cash"),
    )
    tail = s.join(base.select(by, "var_95"), by).where(r <= F.col("var_95")).groupBy(by).agg(F.avg(r).alias("cvar_95"))
    growth = F.try_divide("final_value", "first")
    annual = F.pow(growth, F.lit(YEAR) / F.col("n")) - 1
    over = lambda x: F.coalesce(F.try_divide(annual, x), F.lit(0.0))
    return base.join(tail, by, "left").select(
        by, (growth - 1).alias("cumulative_return"), annual.alias("annual_return"), "volatility", over(F.col("volatility")).alias("sharpe"), over(F.col("downside_deviation")).alias("sortino"),
        "max_drawdown", over(F.abs("max_drawdown")).alias("calmar"), "win_rate", F.coalesce(F.try_divide("__gain", "__loss"), F.lit(0.0)).alias("profit_factor"), "downside_deviation",
        "var_95", F.coalesce("cvar_95", F.lit(0.0)).alias("cvar_95"), "average_turnover", "total_turnover", "total_cost", "total_slippage", F.col("active_steps").cast("long").alias("active_steps"), "average_cash", "final_value",
    )


def benchmark_metrics(curve: DataFrame, benchmark: DataFrame, by: str = "policy", at: str = "date", value: str = "value") -> DataFrame:
    """Figures of each curve against a benchmark(date, value) on common dates; first returns are left out.

    Deviations are of the population. excess_return is the difference of the compound returns by the year and
    information_ratio that over the tracking error. A step from a value of 0 is left out. Curves with fewer than three common dates are left out."""
    both = curve.select(at, by, F.col(value).alias("__v")).join(benchmark.select(at, F.col(value).alias("__b")), at).where("__v is not null and __b is not null")
    w = Window.partitionBy(by).orderBy(at)
    r = both.withColumns({"r": F.try_divide("__v", F.lag("__v").over(w)) - 1, "b": F.try_divide("__b", F.lag("__b").over(w)) - 1}).where("r is not null and b is not null").withColumn("x", F.col("r") - F.col("b"))
    beta = F.coalesce(F.try_divide(F.covar_pop("r", "b"), F.var_pop("b")), F.lit(0.0))
    error = F.stddev_pop("x") * F.sqrt(F.lit(YEAR))
    yearly = lambda c: F.pow(F.product(1 + F.col(c)), F.lit(YEAR) / F.count("*"))
    excess = yearly("r") - yearly("b")
    capture = lambda cond: F.coalesce(F.try_divide(F.avg(F.when(cond, F.col("r"))), F.avg(F.when(cond, F.col("b")))), F.lit(0.0))
    found = r.groupBy(by).agg(
        beta.alias("beta"), ((F.avg("r") - beta * F.avg("b")) * YEAR).alias("alpha"), error.alias("tracking_error"), F.coalesce(F.try_divide(excess, error), F.lit(0.0)).alias("information_ratio"),
        excess.alias("excess_return"), F.coalesce(F.try_divide(F.covar_pop("r", "b"), F.stddev_pop("r") * F.stddev_pop("b")), F.lit(0.0)).alias("correlation"), capture(F.col("b") > 0).alias("up_capture"), capture(F.col("b") < 0).alias("down_capture"), F.count("*").alias("__n"),
    )
    return found.where("__n >= 2").drop("__n")


def prototype_metrics(returns: DataFrame, by: str = "policy", at: str = "date", value: str = "r") -> DataFrame:
    """Total return, drawdown and volatility in percent, Sharpe and Sortino ratio of finite returns.

    Deviations are of the population, the Sortino ratio's of the negative returns alone; a ratio without
    deviation is 0. The peak begins with the first value, after the first return."""
    r = returns.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    w = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    grown = r.withColumn("__g", F.product(1 + F.col(value)).over(w))
    x, year = F.col(value), F.sqrt(F.lit(YEAR))
    stepped = grown.withColumn("__dd", F.coalesce(F.try_divide("__g", F.max("__g").over(w)) - 1, F.lit(0.0)))
    ratio = lambda d: F.coalesce(F.try_divide(F.avg(x), d) * year, F.lit(0.0))
    return stepped.groupBy(by).agg(
        ((F.max_by("__g", at) - 1) * 100).alias("total_return"), ratio(F.stddev_pop(x)).alias("sharpe_ratio"), ratio(F.stddev_pop(F.when(x < 0, x))).alias("sortino_ratio"),
        (F.min("__dd") * 100).alias("max_drawdown"), (F.stddev_pop(x) * year * 100).alias("volatility"),
    )


def sharpe(curve: DataFrame, by: str = "policy", at: str = "date", value: str = "value") -> DataFrame:
    """Mean over sample deviation of returns, by year. A step from a value of 0 is left out."""
    w = Window.partitionBy(by).orderBy(at)
    r = curve.withColumn("__r", F.try_divide(F.col(value), F.lag(value).over(w)) - 1).where("__r is not null")
    return r.groupBy(by).agg(F.coalesce(F.try_divide(F.avg("__r"), F.stddev_samp("__r")) * F.sqrt(F.lit(YEAR)), F.lit(0.0)).alias("sharpe"), F.count("__r").alias("n"))


def probabilistic_z(curve: DataFrame, target: float = 0.0, by: str = "policy", at: str = "date", value: str = "value") -> DataFrame:
    """The normal deviate of the probabilistic Sharpe ratio (Bailey and Lopez de Prado 2012), by central moments.

    A curve without deviation has no ratio: sharpe and z are null, skew 0 and kurtosis 3. z is null too where the
    variance of the estimate is not over 0. A step from a value of 0 is left out."""
    w = Window.partitionBy(by).orderBy(at)
    r = curve.withColumn("__r", F.try_divide(F.col(value), F.lag(value).over(w)) - 1).where("__r is not null")
    x = F.col("__r")
    m = r.groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.avg(x * x).alias("m2"), F.avg(x * x * x).alias("m3"), F.avg(x * x * x * x).alias("m4"))
    mu, s = F.col("m"), F.when(F.col("s") > 0, F.col("s"))
    var = F.when(s.isNotNull() & (F.col("m2") - mu * mu > 0), F.col("m2") - mu * mu)
    skew = F.coalesce((F.col("m3") - 3 * mu * F.col("m2") + 2 * mu * mu * mu) / F.pow(var, F.lit(1.5)), F.lit(0.0))
    kurt = F.coalesce((F.col("m4") - 4 * mu * F.col("m3") + 6 * mu * mu * F.col("m2") - 3 * mu * mu * mu * mu) / (var * var), F.lit(3.0))
    sr = F.try_divide("m", s)
    spread = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    z = F.when(spread > 0, (sr - target) * F.sqrt(F.col("n") - 1) / F.sqrt(spread))
    return m.select(by, "n", sr.alias("sharpe"), skew.alias("skew"), kurt.alias("kurtosis"), z.alias("z"))


def holm(p: DataFrame, value: str = "p", order: list | None = None, within: list[str] | None = None) -> DataFrame:
    """holm: step-down adjusted p. Nulls stay null and do not count."""
    w = Window.partitionBy(*(within or []), F.col(value).isNull())
    ranked = p.withColumns({"__k": F.row_number().over(w.orderBy(value, *(order or []))), "__m": F.count(value).over(w)})
    running = F.max((F.col("__m") - F.col("__k") + 1) * F.col(value)).over(w.orderBy("__k").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("holm", F.when(F.col(value).isNotNull(), F.least(running, F.lit(1.0)))).drop("__k", "__m")


def paired_excess(metrics: DataFrame, baselines: list[str], keys: list[str], value: str, by: str = "policy") -> DataFrame:
    """Rows of each candidate against each baseline of the same keys."""
    base = metrics.where(F.col(by).isin(baselines)).select(*keys, F.col(by).alias("baseline"), F.col(value).alias("__b"))
    return metrics.where(~F.col(by).isin(baselines)).join(base, keys).withColumn("excess", F.col(value) - F.col("__b")).drop("__b")


def transition_summary(curve: DataFrame, by: str = "policy", at: str = "date", value: str = "value") -> DataFrame:
    """Log return, worst drawdown with the first value in it, and turnover."""
    s = _stepped(curve, by, at, value)
    return s.groupBy(by).agg(F.sum(F.log1p("__r")).alias("log_return"), F.min("__dd").alias("max_drawdown"), F.sum("turnover").alias("turnover"), F.count("*").alias("transitions"))


def evidence_summary(steps: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Twelve figures of transitions(before and after values of candidate, equal weight and index, costs).

    Drawdowns count the value before the first transition as a peak."""
    w = Window.partitionBy(*keys).orderBy(at)
    past = w.rowsBetween(Window.unboundedPreceding, 0)

    def drawdown(name: str) -> Column:
        before, after = F.col(f"{name}_before"), F.col(f"{name}_after")
        return F.least(after / F.greatest(F.max(after).over(past), F.first(before).over(past)) - 1, F.lit(0.0))

    names = ("portfolio_value", "equal_weight_value", "set_index_value")
    x = steps.withColumns({f"__d{i}": drawdown(n) for i, n in enumerate(names[:2])} | {f"__r{i}": F.col(f"{n}_after") / F.col(f"{n}_before") - 1 for i, n in enumerate(names)})
    return x.groupBy(*keys).agg(
        F.count("*").alias("transitions"), (F.max_by("portfolio_value_after", at) / F.min_by("portfolio_value_before", at) - 1).alias("net_cumulative_return"), F.sum(F.log1p("__r0")).alias("net_log_return"), F.min("__d0").alias("max_drawdown"),
        F.avg("turnover").alias("mean_turnover"), F.sum("turnover").alias("total_turnover"), F.sum("transaction_cost_paid").alias("total_cost"), F.sum("slippage_paid").alias("total_slippage"),
        F.sum(F.log1p("__r1")).alias("equal_weight_net_log_return"), F.min("__d1").alias("equal_weight_max_drawdown"), F.sum(F.log1p("__r2")).alias("set_index_net_log_return"), F.stddev_pop("__r0").alias("__sd"),
    )


def metric_row(steps: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The row of a candidate's ledger: the evidence with the Sharpe ratio of compound return over deviation."""
    m = evidence_summary(steps, keys, at)
    annual = F.pow(1 + F.col("net_cumulative_return"), F.lit(YEAR) / F.col("transitions")) - 1
    sharpe = F.coalesce(F.try_divide(annual, F.col("__sd") * F.sqrt(F.lit(YEAR))), F.lit(0.0))
    return m.select(*keys, F.lit("complete").alias("status"), "net_cumulative_return", "net_log_return", sharpe.alias("sharpe"), "max_drawdown", F.col("mean_turnover").alias("turnover"), "equal_weight_net_log_return", "equal_weight_max_drawdown", "set_index_net_log_return")


def action_summary(actions: DataFrame) -> DataFrame:
    """Mean and greatest weight of each policy and ticker, and the days on which it is held."""
    return actions.groupBy("policy", "ticker").agg(F.avg("weight").alias("mean_weight"), F.max("weight").alias("max_weight"), F.count_if(F.col("weight") > 1e-6).alias("active_days"))


def seed_means(curves: DataFrame, policy: str = "policy", at: str = "date", value: str = "value") -> DataFrame:
    """variant, date and the mean value over seeds; a policy's variant is its name without _seed and a number."""
    return curves.groupBy(F.regexp_replace(policy, "_seed[0-9]+$", "").alias("variant"), at).agg(F.avg(value).alias(value))
