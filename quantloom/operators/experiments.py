"""Suites over regimes and windows, exit paths, and the tables that experiments leave behind."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exits as X
from . import metrics as M
from . import portfolio as P
from .contracts import NONTRADING_STATES
from .splits import walk_forward
from .windows import crossover as crossed


def crossover(panel: DataFrame, name: str = "ma_crossover") -> DataFrame:
    """Equal weights of the names whose short mean of close is over the long one; all cash where there is none."""
    on = panel.withColumn("__on", crossed().cast("double"))
    return on.select(F.lit(name).alias("policy"), "date", "ticker", F.coalesce(F.try_divide("__on", F.sum("__on").over(Window.partitionBy("date"))), F.lit(0.0)).alias("weight"))


def holds(panel: DataFrame) -> DataFrame:
    """Buy-and-hold of each name, one plan for all: all of the capital on the dates on which the name has a row, else cash."""
    own = panel.select("date", "ticker").distinct().withColumn("weight", F.lit(1.0))
    grid = panel.select("date").distinct().crossJoin(F.broadcast(panel.select("ticker").distinct()))
    return grid.join(own, ["date", "ticker"], "left").select(F.concat(F.lit("buy_hold_"), "ticker").alias("policy"), "date", "ticker", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def baselines(panel: DataFrame, seed: int = 42) -> DataFrame:
    """Weights of all baselines over panel(date, ticker, close, return_1d, return_5d): equal weight, random, momentum, moving-average
    crossover, mean variance, and buy-and-hold of each name."""
    solved = P.mean_variance(panel.select("date", "ticker", F.col("return_1d").alias("r")))
    parts = [P.equal_weight(panel), P.random_weights(panel, seed), P.momentum(panel, "return_5d"), crossover(panel), solved, holds(panel)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def regime_suite(panel: DataFrame, returns: DataFrame, regimes: dict[str, tuple[str, str]], lookback: int, cost: float = 0.0015, slippage: float = 0.0005) -> DataFrame:
    """regime and the metrics of each baseline inside it; a regime needs lookback + 2 dates.

    The weights of all regimes are curves of one plan: the policy's name carries the regime."""
    r = panel.sparkSession.createDataFrame([(k, *v) for k, v in regimes.items()], "regime string, a string, b string").select("regime", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    dates = panel.select("date").distinct().join(F.broadcast(r), F.col("date").between(F.col("a"), F.col("b")))
    enough = dates.groupBy("regime").agg(F.count("*").alias("n")).where(F.col("n") >= lookback + 2)
    kept = dates.join(F.broadcast(enough), "regime").select("regime", "date")
    w = baselines(panel).join(F.broadcast(kept), "date").withColumn("policy", F.concat_ws("/", "regime", "policy")).drop("regime")
    m = M.equity_metrics(P.closed_form(w, returns, cost, slippage))
    return m.select(F.substring_index("policy", "/", 1).alias("regime"), F.substring_index("policy", "/", -1).alias("baseline"), *(c for c in m.columns if c != "policy"))


def walk_forward_run(panel: DataFrame, returns: DataFrame, train: int, validation: int, test: int, step: int, cost: float = 0.0015, slippage: float = 0.0005) -> DataFrame:
    """window, split, baseline and metrics: the baselines on the splits after the training of each window."""
    windows = walk_forward(panel, train, validation, test, step).where("split != 'train'")
    w = baselines(panel).join(F.broadcast(windows), "date").withColumn("policy", F.concat_ws("/", F.col("window").cast("string"), "split", "policy"))
    m = M.equity_metrics(P.closed_form(w.select("policy", "date", "ticker", "weight"), returns, cost, slippage))
    part = lambda k: F.get(F.split("policy", "/"), F.lit(k))
    return m.select(part(0).cast("int").alias("window"), part(1).alias("split"), part(2).alias("baseline"), *(c for c in m.columns if c != "policy"))


def exit_ledger(states: DataFrame, by: str = "ticker", at: str = "date") -> DataFrame:
    """Each exit from membership, and the session that decides it.

    states(date, ticker, member, status, valid_bar, terminal_action) has a row for each session of a ticker.
    From the exit on sessions without trading are passed over; the first other one decides: trading with a bar
    liquidates, delisted with an action settles, and a missing status, a missing bar or action, or any other
    state leaves the exit unresolved for that reason. One exchange: the decision is the next deciding row,
    carried backwards."""
    w = Window.partitionBy(by).orderBy(at)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    decides = F.col("status").isNull() | ~F.col("status").isin(*NONTRADING_STATES)
    x = states.withColumns({"__i": F.row_number().over(w), "__was": F.lag("member").over(w)})
    x = x.withColumn("__d", F.first(F.when(decides, F.struct(F.col("__i").alias("i"), F.col(at).alias("at"), "status", "valid_bar", "terminal_action")), ignorenulls=True).over(ahead))
    exits = x.where(F.col("__was") & ~F.col("member"))
    d, state = F.col("__d"), F.col("__d.status")
    sold, settled = (state == "trading") & F.col("__d.valid_bar"), (state == "delisted") & F.col("__d.terminal_action").isNotNull()
    covered = F.coalesce(sold, F.lit(False)) | F.coalesce(settled, F.lit(False))
    reason = (
        F.when(covered, "").when(d.isNull(), X.ENDS).when(state.isNull(), X.NO_STATUS).when(state == "trading", X.NO_BAR)
        .when(state == "delisted", X.NO_ACTION).otherwise(F.concat(F.lit(X.ODD), state))
    )
    return exits.select(
        by, F.col(at).alias("exit_date"), F.when(covered, F.col("__d.at")).alias("liquidation_date"), F.when(covered, F.col("__d.i") - F.col("__i")).cast("long").alias("lag_sessions"),
        F.when(F.coalesce(sold, F.lit(False)), X.SOLD).when(F.coalesce(settled, F.lit(False)), X.SETTLED).otherwise(X.UNRESOLVED).alias("path_status"), reason.alias("blocking_reason"),
    )


def best_trials(scores: DataFrame, keys: list[str], value: str, name: str, trials: int, split: str = "split") -> DataFrame:
    """The best validation trial of each key, how many trials it has, and whether that is all of them.

    A score of another split fails the job: tests must not choose."""
    guarded = scores.withColumn(split, F.when(F.col(split) == "validation", F.col(split)).otherwise(F.raise_error(F.concat(F.lit("not a validation score: "), F.coalesce(split, F.lit("null"))))))
    order = F.struct((-F.col(value)).alias("v"), F.col(name).alias("n"))
    best = guarded.where(F.col(split).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(name, value, split), F.when(F.col(value).isNotNull(), order)).alias("__x"), F.count("*").alias("trials"))
    return best.where("__x is not null").select(*keys, "__x.*", "trials").withColumn("complete", F.col("trials") == trials)


def trial_algorithms(trials: DataFrame, algorithms: list[str]) -> DataFrame:
    """trial_id with its algorithm, in turn, and its number within that."""
    n = len(algorithms)
    return trials.select("trial_id", F.get(F.array(*(F.lit(a) for a in algorithms)), F.pmod("trial_id", F.lit(n)).cast("int")).alias("algorithm"), F.floor(F.col("trial_id") / n).cast("long").alias("trial"))


#: What is drawn for off-policy and for on-policy algorithms; (low, high) is a range, log10 where marked.
OFF_POLICY_SPACE = {"gamma": [0.95, 0.98, 0.99, 0.995], "tau": [0.001, 0.005, 0.01, 0.02], "buffer_size": [25_000, 50_000, 100_000], "learning_starts": [100, 500, 1000], "batch_size": [64, 128, 256], "train_freq": [1, 4, 8], "gradient_steps": [1, 4, 8]}
ON_POLICY_SPACE = {"gamma": [0.90, 0.95, 0.98, 0.99, 0.995], "ent_coef": [0.0, 1e-5, 1e-4, 1e-3, 1e-2], "n_steps": [64, 128, 256, 512]}


#: The entropy coefficients of the off-policy algorithm that has one.
ENTROPY_CHOICES = ["auto", "0.001", "0.01", "0.1"]


def sample_parameters(trials: DataFrame, seed: int) -> DataFrame:
    """trial_id, algorithm and params (a map of texts): draws seeded by the trial, so any trial can be made alone."""

    def draw(batches):
        for batch in batches:
            out = []
            for t, a, k in zip(batch["trial_id"], batch["algorithm"], batch["trial"], strict=True):
                r = np.random.default_rng([seed, int(k), *a.encode()])
                space = OFF_POLICY_SPACE if a in ("ddpg", "td3", "sac") else ON_POLICY_SPACE
                p = {"learning_rate": float(10 ** r.uniform(-5, np.log10(3e-3)))} | {n: r.choice(v).item() for n, v in space.items()}
                if a in ("ppo", "a2c"):
                    p["gae_lambda"] = float(r.uniform(0.80, 0.99))
                if a == "ppo":
                    p |= {"clip_range": float(r.uniform(0.10, 0.30)), "batch_size": min(r.choice([32, 64, 128, 256]).item(), p["n_steps"])}
                if a == "sac":
                    p["ent_coef"] = r.choice(ENTROPY_CHOICES).item()
                if a == "td3":
                    p["policy_delay"] = r.choice([1, 2, 3]).item()
                out.append((t, a, {n: str(v) for n, v in p.items()}))
            yield pd.DataFrame(out, columns=["trial_id", "algorithm", "params"])

    return trials.mapInPandas(draw, "trial_id long, algorithm string, params map<string,string>")


def stage_levels(stages: DataFrame, most: int = 1000) -> DataFrame:
    """stage and level of stages(stage, needs): 0 without needs, else one more than the greatest level needed.

    A plan of stages is small. Each round settles those whose needs are settled; a round that settles none while
    some are left has met a cycle or an unknown stage."""
    needs: dict[str, set[str]] = {}
    for r in stages.collect():
        needs.setdefault(r.stage, set()).update([r.needs] if r.needs else [])
    level: dict[str, int] = {}
    for depth in range(most):
        ready = [s for s in needs if s not in level and needs[s] <= level.keys()]
        if not ready:
            break
        level |= dict.fromkeys(ready, depth)
    if len(level) < len(needs):
        raise ValueError(f"a cycle or an unknown stage at {', '.join(sorted(set(needs) - set(level)))}")
    return stages.sparkSession.createDataFrame(sorted(level.items()), "stage string, level int")


def manifest_summary(texts: DataFrame) -> DataFrame:
    """experiment, runs, complete and last_run of manifests(text) in JSON; texts that are no manifest have no experiment and go."""
    m = texts.select(F.from_json("text", "experiment string, run long, status string").alias("m")).where("m.experiment is not null")
    return m.groupBy(F.col("m.experiment").alias("experiment")).agg(F.count("*").alias("runs"), F.count_if(F.col("m.status") == "complete").alias("complete"), F.max("m.run").alias("last_run"))


def reusable(wanted: DataFrame, done: DataFrame, identity: list[str], objective: str) -> DataFrame:
    """wanted with reusable: whether done has a row of exactly this identity with a finite objective."""
    fine = done.where(F.col(objective).isNotNull() & ~F.isnan(objective) & (F.abs(objective) < float("inf"))).select(*identity).distinct().withColumn("__d", F.lit(True))
    return wanted.join(fine, identity, "left").withColumn("reusable", F.col("__d").isNotNull()).drop("__d")


def trajectory_digest(curve: DataFrame, by: str = "policy", at: str = "date", value: str = "value", places: int = 2) -> DataFrame:
    """policy, steps and the SHA-256 of its dates and values in order, in units of the last place."""
    item = F.struct(F.col(at).alias("k"), F.concat_ws(":", F.col(at).cast("string"), F.round(F.col(value) * 10**places).cast("long").cast("string")).alias("t"))
    return curve.groupBy(by).agg(F.count("*").alias("steps"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ","), 256).alias("digest"))
