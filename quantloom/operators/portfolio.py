"""Portfolio accounting: a closed form where there is one, grouped simulators where paths matter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def closed_form(weights: DataFrame, returns: DataFrame, cost: float, slippage: float, capital: float = 100_000.0) -> DataFrame:
    """Curves of weights(policy, date, ticker, weight) over returns(date, ticker, r) without a turnover cap.

    A decision at a date earns that date's returns; what is not invested is cash. Weights do not
    drift: turnover is the change of targets, the cash leg included. Two exchanges whatever the
    number of dates: by policy and ticker for changes, by policy for the product. drawdown is the share lost
    since the peak, the capital included: 0 or more."""
    asset = Window.partitionBy("policy", "ticker").orderBy("date")
    changed = weights.withColumn("move", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(asset), F.lit(0.0))))
    steps = changed.join(returns.select("date", "ticker", "r"), ["date", "ticker"], "left").groupBy("policy", "date").agg(
        F.sum("move").alias("move"), F.sum("weight").alias("invested"), F.sum(F.col("weight") * F.coalesce("r", F.lit(0.0))).alias("gross")
    )
    w = Window.partitionBy("policy").orderBy("date")
    cash = 1 - F.col("invested")
    steps = steps.withColumn("turnover", F.col("move") + F.abs(cash - F.coalesce(F.lag(cash).over(w), F.lit(1.0))))
    steps = steps.withColumns({"cost": F.col("turnover") * cost, "slippage": F.col("turnover") * slippage})
    steps = steps.withColumn("net", F.col("gross") - F.col("cost") - F.col("slippage"))
    value = capital * F.product(1 + F.col("net")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("value", value)
    peak = F.greatest(F.lit(capital), F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return steps.select("policy", "date", "value", "net", "turnover", "cost", "slippage", (1 - F.col("value") / peak).alias("drawdown"), cash.alias("cash_weight"))


def turnover_of(target: np.ndarray, held: np.ndarray) -> float:
    """The moves of all weights, that of cash included."""
    return float(np.abs(target - held).sum() + abs(target.sum() - held.sum()))


def limit_turnover(target: np.ndarray, held: np.ndarray, most: float, most_weight: float = 1.0) -> np.ndarray:
    """The move towards target, scaled down to the allowed turnover."""
    size = turnover_of(target, held)
    return target if size <= most or size == 0 else np.clip(held + (target - held) * (most / size), 0.0, most_weight)


def simulate(weights: DataFrame, returns: DataFrame, cost: float, cap: float = np.inf, every: int = 1, drift: bool = True, capital: float = 100_000.0) -> DataFrame:
    """Path-dependent curves: capped turnover, drifting weights, trades every so many sessions.

    Costs are multiplicative and funded from the value. The group is one policy: the parallel axis
    is policies, seeds, folds and scenarios."""
    joined = weights.join(returns.select("date", "ticker", "r"), ["date", "ticker"], "left").select("policy", "date", "ticker", "weight", F.coalesce("r", F.lit(0.0)).alias("r"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        goal = rows.pivot_table(index="date", columns="ticker", values="weight", aggfunc="last").fillna(0.0).sort_index()
        moves = rows.pivot_table(index="date", columns="ticker", values="r", aggfunc="last").reindex_like(goal).fillna(0.0).to_numpy()
        held, value, out = np.zeros(goal.shape[1]), capital, []
        for i, target in enumerate(goal.to_numpy()):
            turnover = 0.0
            if i % every == 0:
                new = limit_turnover(target, held, cap)
                turnover, held = turnover_of(new, held), new
            value *= 1 - turnover * cost
            gross = float(held @ moves[i])
            value *= 1 + gross
            out.append((value, turnover, turnover * cost, gross, 1 - float(held.sum())))
            if drift and 1 + gross > 0:
                held = held * (1 + moves[i]) / (1 + gross)
        v, t, c, g, cash = zip(*out, strict=True)
        return pd.DataFrame({"policy": rows["policy"].iloc[0], "date": goal.index, "value": v, "turnover": t, "cost": c, "gross": g, "cash_weight": cash})

    return joined.groupBy("policy").applyInPandas(run, "policy string, date date, value double, turnover double, cost double, gross double, cash_weight double")


def execute(orders: DataFrame, cost: float, cap: float) -> DataFrame:
    """One self-financing rebalance for each policy and date of orders(policy, date, ticker, held, target, can_buy, can_sell, forced_exit).

    held and target are shares of the value. Forced exits go first and outside the cap; names that may
    not be bought or sold stay; the cap scales the other moves; costs come out of cash, and buys
    shrink so that cash does not go below zero."""
    want = F.when(F.col("forced_exit") & F.col("can_sell"), 0.0).when(~F.col("can_sell"), F.greatest("target", "held")).otherwise(F.col("target"))
    want = F.when(~F.col("can_buy"), F.least(want, F.col("held"))).otherwise(want)
    w = Window.partitionBy("policy", "date")
    x = orders.withColumn("want", want).withColumn("move", F.col("want") - F.col("held")).withColumn("must", F.col("forced_exit") & F.col("can_sell"))
    free = F.sum(F.when(~F.col("must"), F.abs("move")).otherwise(0.0)).over(w)
    x = x.withColumn("move", F.when(~F.col("must") & (free > cap), F.col("move") * cap / free).otherwise(F.col("move")))
    sells, buys = F.sum(F.greatest(-F.col("move"), F.lit(0.0))).over(w), F.sum(F.greatest("move", F.lit(0.0))).over(w)
    cash = 1 - F.sum("held").over(w) + sells * (1 - cost)
    x = x.withColumns({"__cash": cash, "__need": buys * (1 + cost)})
    scale = F.when(F.col("__need") > F.col("__cash"), F.greatest("__cash", F.lit(0.0)) / F.nullif("__need", F.lit(0.0))).otherwise(1.0)
    x = x.withColumn("trade", F.when(F.col("move") > 0, F.col("move") * scale).otherwise(F.col("move")))
    return x.withColumns({"paid": F.abs("trade") * cost, "after": F.col("held") + F.col("trade")}).drop("__cash", "__need", "must", "want", "move")


def equal_weight(panel: DataFrame, name: str = "equal_weight") -> DataFrame:
    return panel.select(F.lit(name).alias("policy"), "date", "ticker", (1.0 / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


def momentum(panel: DataFrame, signal: str, name: str = "momentum") -> DataFrame:
    """Shares of the positive signal of the session before; all cash where none is positive."""
    before = F.greatest(F.coalesce(F.lag(signal).over(Window.partitionBy("ticker").orderBy("date")), F.lit(0.0)), F.lit(0.0))
    x = panel.withColumn("__s", before)
    return x.select(F.lit(name).alias("policy"), "date", "ticker", F.coalesce(F.try_divide(F.col("__s"), F.sum("__s").over(Window.partitionBy("date"))), F.lit(0.0)).alias("weight"))


def single_name(panel: DataFrame, ticker: str) -> DataFrame:
    return panel.select(F.lit(f"hold_{ticker}").alias("policy"), "date", "ticker", (F.col("ticker") == ticker).cast("double").alias("weight"))


def masked_equal(panel: DataFrame, mask: str, name: str = "active_equal") -> DataFrame:
    on = F.col(mask).cast("double")
    return panel.select(F.lit(name).alias("policy"), "date", "ticker", F.coalesce(F.try_divide(on, F.sum(on).over(Window.partitionBy("date"))), F.lit(0.0)).alias("weight"))


def mean_variance(returns: DataFrame, window: int = 60, ridge: float = 1e-4) -> DataFrame:
    """Long-only weights pinv(cov + ridge I) mean over the window of returns that ends with each date.

    The first date has no return. With fewer than two returns weights are equal; where no raw weight is
    positive all is cash. Each date becomes one row of its window, an array of arrays over the tickers in
    order: a date's returns are sent to the dates whose window holds them, so dates are solved in parallel and
    a task holds one window at a time. Dates are numbered as a small dimension."""
    from .splits import numbered

    tickers = returns.select("ticker").distinct().groupBy().agg(F.array_sort(F.collect_set("ticker")).alias("names"))
    vectors = returns.join(F.broadcast(numbered(returns)), "date").groupBy("date", "i").agg(F.map_from_entries(F.collect_set(F.struct("ticker", F.coalesce("r", F.lit(0.0))))).alias("m"))
    dated = vectors.crossJoin(F.broadcast(tickers)).select("date", "i", "names", F.transform("names", lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0))).alias("v"))
    sent = dated.where("i > 0").select(F.explode(F.sequence("i", F.col("i") + (window - 1))).alias("at"), F.struct("i", "v").alias("x"))
    windows = sent.groupBy("at").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("past"))
    rows = dated.join(windows, F.col("i") == F.col("at"), "left").select("date", "names", "past")

    def solve(batches):
        for batch in batches:
            out = []
            for day, names, past in zip(batch["date"], batch["names"], batch["past"], strict=True):
                n, w = len(names), None
                if past is None or len(past) < 2:
                    w = np.full(n, 1.0 / n)
                else:
                    x = np.stack(past)
                    raw = np.maximum(np.linalg.pinv(np.atleast_2d(np.cov(x, rowvar=False)) + ridge * np.eye(n)) @ x.mean(0), 0.0)
                    w = raw / raw.sum() if raw.sum() > 0 else np.zeros(n)
                out += [("mean_variance", day, t, float(v)) for t, v in zip(names, w, strict=True)]
            yield pd.DataFrame(out, columns=["policy", "date", "ticker", "weight"])

    return rows.mapInPandas(solve, "policy string, date date, ticker string, weight double")


def chained(curves: DataFrame) -> DataFrame:
    """Out-of-sample curves of folds, chained: each starts where the one before ended."""
    w = Window.partitionBy("policy", "fold").orderBy("date")
    rel = curves.withColumn("__rel", F.col("value") / F.first("value").over(w))
    ends = rel.groupBy("policy", "fold").agg(F.max_by("__rel", "date").alias("__end"))
    before = ends.withColumn("__k", F.coalesce(F.product("__end").over(Window.partitionBy("policy").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    return rel.join(before.select("policy", "fold", "__k"), ["policy", "fold"]).select("policy", "fold", "date", (F.col("__rel") * F.col("__k")).alias("growth"))


def price_benchmark(series: DataFrame, price: str, cost: float, slippage: float, capital: float = 100_000.0, at: str = "date") -> DataFrame:
    """Buy-and-hold of a price series(date, price), one row a date: the first value is the capital, those after
    it capital (1 - cost - slippage) price / first price; the turnover of 1 is at the second date."""
    w = Window.orderBy(at)
    x = series.select(at, F.col(price).alias("__p")).withColumns({"__k": F.row_number().over(w), "__f": F.first("__p").over(w)})
    value = F.when(F.col("__k") == 1, F.lit(capital)).otherwise(capital * (1 - cost - slippage) * F.col("__p") / F.col("__f"))
    return x.select(at, value.alias("value"), F.when(F.col("__k") == 2, 1.0).otherwise(0.0).alias("turnover"))


def reward_terms(curve: DataFrame, turnover_penalty: float, drawdown_penalty: float, by: str = "policy", at: str = "date", value: str = "value") -> DataFrame:
    """simple and log reward (with a floor on the return), drawdown by level and by increment (never negative), and
    reward: the log return less the penalties of turnover and drawdown level."""
    w = Window.partitionBy(by).orderBy(at)
    peak = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = curve.withColumns({"simple_reward": F.coalesce(F.try_divide(F.col(value), F.lag(value).over(w)) - 1, F.lit(0.0)), "drawdown_level": 1 - F.coalesce(F.try_divide(F.col(value), peak), F.lit(1.0))})
    x = x.withColumns({"log_reward": F.log1p(F.greatest("simple_reward", F.lit(-0.999999))), "drawdown_increment": F.greatest(F.col("drawdown_level") - F.coalesce(F.lag("drawdown_level").over(w), F.lit(0.0)), F.lit(0.0))})
    return x.withColumn("reward", F.col("log_reward") - turnover_penalty * F.col("turnover") - drawdown_penalty * F.col("drawdown_level"))


def ledger_step(orders: DataFrame, cost: float, slippage: float, cap: float | None = None, tolerance: float = 1e-12) -> DataFrame:
    """One self-financing rebalance of each policy and date of orders(policy, date, ticker, held, target, can_buy,
    can_sell, forced_exit, r), with pending, executed, trade and ending_weight.

    Shares are of the wealth before. A forced exit that may be sold goes, outside the cap; one that may not is
    pending and frozen. Blocked buys and sells stay as held. The cap holds for the moves that are left after the
    mandatory ones. Sales pay their cost; purchases shrink together until cash covers them and theirs."""
    w = Window.partitionBy("policy", "date")
    held, target, rate = F.greatest("held", F.lit(0.0)), F.greatest("target", F.lit(0.0)), cost + slippage
    must, pending = F.col("forced_exit") & F.col("can_sell"), F.col("forced_exit") & ~F.col("can_sell")
    blocked = (~F.col("can_buy") & (target > held)) | (~F.col("can_sell") & (target < held))
    x = orders.withColumns({"__h": held, "pending": pending, "__must": must, "__p": F.when(must, 0.0).when(pending | blocked, held).otherwise(target), "__m": F.when(must, 0.0).otherwise(held)})
    x = x.withColumns({"__mand": F.sum(F.col("__h") - F.col("__m")).over(w), "__disc": F.sum(F.abs(F.col("__p") - F.col("__m"))).over(w)})
    room = F.greatest(F.lit(cap if cap is not None else float("inf")) - F.col("__mand"), F.lit(0.0))
    scale = F.when(F.col("__disc") > room + tolerance, room / F.col("__disc")).otherwise(1.0)
    x = x.withColumn("__d", F.col("__m") + scale * (F.col("__p") - F.col("__m")) - F.col("__h"))
    x = x.withColumns({"__sold": F.least("__d", F.lit(0.0)), "__bought": F.greatest("__d", F.lit(0.0))})
    x = x.withColumns({"__cash": F.greatest(1 - F.sum(F.col("__h") + F.col("__sold")).over(w) + rate * F.sum("__sold").over(w), F.lit(0.0)), "__need": F.sum("__bought").over(w) * (1 + rate)})
    part = F.when(F.col("__need") > F.col("__cash") + tolerance, F.col("__cash") / F.col("__need")).otherwise(1.0)
    x = x.withColumn("executed", F.col("__h") + F.col("__sold") + part * F.col("__bought")).withColumn("trade", F.col("executed") - F.col("__h"))
    multiplier = F.sum(F.col("executed") * (1 + F.coalesce("r", F.lit(0.0)))).over(w) + 1 - F.sum("executed").over(w) - rate * F.sum(F.abs("trade")).over(w)
    return x.withColumn("multiplier", multiplier).withColumn("ending_weight", F.col("executed") * (1 + F.coalesce("r", F.lit(0.0))) / F.col("multiplier")).withColumnRenamed("__mand", "mandatory").drop("__h", "__p", "__m", "__disc", "__d", "__sold", "__bought", "__cash", "__need", "__must")


def ledger_totals(steps: DataFrame, cost: float, slippage: float, cap: float | None = None) -> DataFrame:
    """Turnover, costs, returns and cash of each rebalance of ledger_step, whether mandatory exits went over the cap,
    and whether wealth reconciles: 1 + gross - costs, and weights and cash that add up to one."""
    gross = F.sum(F.col("executed") * F.coalesce("r", F.lit(0.0)))
    t = steps.groupBy("policy", "date").agg(F.sum(F.abs("trade")).alias("turnover"), gross.alias("gross_return"), F.max("multiplier").alias("multiplier"), F.sum("executed").alias("__e"), F.sum("ending_weight").alias("__w"), F.max("mandatory").alias("__m"))
    t = t.withColumns({"transaction_cost_paid": cost * F.col("turnover"), "slippage_paid": slippage * F.col("turnover"), "net_return": F.col("multiplier") - 1})
    t = t.withColumn("ending_cash", (1 - F.col("__e") - F.col("transaction_cost_paid") - F.col("slippage_paid")) / F.col("multiplier"))
    closes = (F.abs(F.col("multiplier") - (1 + F.col("gross_return") - F.col("transaction_cost_paid") - F.col("slippage_paid"))) <= 1e-10) & (F.abs(F.col("__w") + F.col("ending_cash") - 1) <= 1e-10)
    over = F.lit(False) if cap is None else F.col("__m") > cap + 1e-12
    return t.withColumns({"limit_overridden": over, "reconciles": closes}).drop("__e", "__w", "__m", "multiplier")


def masked_targets(actions: DataFrame) -> DataFrame:
    """actions(date, ticker, eligible, action) with weight and forced_exit: nothing for names that are not eligible,
    no more than the capital in all, and a forced exit where a name stops being eligible."""
    w = F.when(F.col("eligible"), F.greatest("action", F.lit(0.0))).otherwise(0.0)
    was = F.lag("eligible").over(Window.partitionBy("ticker").orderBy("date"))
    x = actions.withColumns({"__w": w, "forced_exit": F.coalesce(was & ~F.col("eligible"), F.lit(False))}).withColumn("__t", F.sum("__w").over(Window.partitionBy("date")))
    return x.withColumn("weight", F.when(F.col("__t") > 1, F.col("__w") / F.col("__t")).otherwise(F.col("__w"))).drop("__w", "__t")


def random_weights(panel: DataFrame, seed: int, name: str = "random") -> DataFrame:
    """Random long-only weights of each date, whose draw is seeded by the date: dates are made in parallel.

    Shares are uniform draws, scaled down where they add up to more than 1; what they leave is cash."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ticker")
        day = rows["date"].iloc[0]
        raw = np.random.default_rng([seed, day.toordinal()]).random(len(rows))
        return pd.DataFrame({"policy": name, "date": day, "ticker": rows["ticker"], "weight": raw / max(raw.sum(), 1.0)})

    return panel.select("date", "ticker").groupBy("date").applyInPandas(run, "policy string, date date, ticker string, weight double")


def return_benchmark(series: DataFrame, lookback: int, cost: float, slippage: float, capital: float = 100_000.0) -> DataFrame:
    """Buy-and-hold of series(date, r), one row a date: opens with the capital at the row after the lookback, the
    step that follows bears a turnover of 2, later ones none. Returns that are not finite count as 0."""
    w = Window.orderBy("date")
    k = F.col("__k")
    r = F.when(F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") < float("inf")), F.col("r")).otherwise(0.0)
    x = series.withColumn("__k", F.row_number().over(w)).where(k > lookback).withColumn("turnover", F.when(k == lookback + 2, 2.0).otherwise(0.0))
    x = x.withColumn("net", F.when(k == lookback + 1, 0.0).otherwise(r - F.col("turnover") * (cost + slippage)))
    x = x.withColumn("value", capital * F.product(1 + F.col("net")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    peak = F.greatest(F.lit(capital), F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.select("date", "value", "net", "turnover", (1 - F.col("value") / peak).alias("drawdown"))


def rebalanced_growth(prices: DataFrame, every: int) -> DataFrame:
    """date and growth of equal weights that are set every so many dates and drift between.

    A block is the mean of its names' growth since its first date, so blocks are made in parallel; a block ends
    at the first date of the next, and blocks are chained by their ends, one row a block."""
    from .splits import numbered

    dates = numbered(prices).withColumn("block", F.floor(F.col("i") / every))
    starts = dates.groupBy("block").agg(F.min("date").alias("start"))
    starts = starts.withColumn("next", F.lead("start").over(Window.orderBy("block")))
    bases = prices.select(F.col("date").alias("start"), "ticker", F.col("close").alias("base")).join(F.broadcast(starts), "start")
    inside = prices.join(F.broadcast(dates), "date").join(bases.select("block", "ticker", "base"), ["block", "ticker"])
    growth = inside.groupBy("block", "date").agg(F.avg(F.col("close") / F.col("base")).alias("g"))
    ends = bases.join(prices.select(F.col("date").alias("next"), "ticker", "close"), ["next", "ticker"]).groupBy("block").agg(F.avg(F.col("close") / F.col("base")).alias("__e"))
    chain = starts.join(ends, "block", "left").withColumn("__k", F.coalesce(F.product(F.coalesce("__e", F.lit(1.0))).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    return growth.join(F.broadcast(chain.select("block", "__k")), "block").select("date", (F.col("g") * F.col("__k")).alias("growth"))


def stress(weights: DataFrame, returns: DataFrame, scenarios: dict[str, tuple[float, float]], stored: DataFrame, base: str = "base", tolerance: float = 1e-9) -> DataFrame:
    """scenario, final_value, turnover, change from the base scenario, and replays: whether its values are those of
    the stored curve. The steps are made once; each scenario is a curve of them."""
    spark = weights.sparkSession
    table = spark.createDataFrame([(n, c, s) for n, (c, s) in scenarios.items()], "scenario string, __c double, __s double")
    steps = closed_form(weights, returns, 0.0, 0.0).select("policy", "date", F.col("net").alias("gross"), "turnover")
    x = steps.crossJoin(F.broadcast(table)).withColumn("net", F.col("gross") - F.col("turnover") * F.col("__c") - F.col("turnover") * F.col("__s"))
    x = x.withColumn("value", 100_000.0 * F.product(1 + F.col("net")).over(Window.partitionBy("scenario", "policy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    apart = x.join(stored.select("policy", "date", F.col("value").alias("__v")), ["policy", "date"]).groupBy("scenario").agg(F.max(F.abs(F.col("value") / F.col("__v") - 1)).alias("__gap"))
    t = x.groupBy("scenario").agg(F.max_by("value", "date").alias("final_value"), F.sum("turnover").alias("turnover")).join(apart, "scenario")
    first = t.where(F.col("scenario") == base).select(F.col("final_value").alias("__b"))
    return t.crossJoin(F.broadcast(first)).select("scenario", "final_value", "turnover", (F.col("final_value") - F.col("__b")).alias("change"), (F.col("__gap") <= tolerance).alias("replays"))


def rollout(weights: DataFrame, returns: DataFrame, cost: float, slippage: float) -> tuple[DataFrame, DataFrame]:
    """The curve of weights with its steps from 0, and the actions of each step."""
    w = Window.partitionBy("policy").orderBy("date")
    curve = closed_form(weights, returns, cost, slippage).withColumn("step", F.row_number().over(w).cast("long") - 1)
    actions = weights.join(curve.select("policy", "date", "step"), ["policy", "date"]).select("policy", "date", "step", "ticker", "weight")
    return curve, actions
